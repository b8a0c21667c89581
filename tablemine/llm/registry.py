"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .chat import op8_offset_masks
from .cws import op10_weighted_sampling
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_layout import op9_layout
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op7_packing
from .pii import op5_semi_markov
from .quality import op1_divergence
from .recompress import OP4_SQL, op4_recompression
from .ring import op6_ring
from .source_audit import OP12_SQL, op12_source_audit
from .toxicity import op11_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_recompression": op4_recompression,
    "op5_semi_markov": op5_semi_markov,
    "op6_ring": op6_ring,
    "op7_packing": op7_packing,
    "op8_offset_masks": op8_offset_masks,
    "op9_layout": op9_layout,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op11_toxicity": op11_toxicity,
    "op12_source_audit": op12_source_audit,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op3_ngram_join": OP3_SQL,
    "op4_recompression": OP4_SQL,
    "op12_source_audit": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
