"""Prompt budgets in tokens.

The tokenizer is the user's: ``factory()`` is called once per Python worker
task and returns a function that gives, for a list of texts, each text's token
offsets (start, end) in characters.  A text over the budget is cut where its
last token within the budget ends, so the kept part is the text itself and
never what a decoder makes of it; a text within the budget stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.common import col

Offsets = Sequence[tuple[int, int]]
TokenizerFactory = Callable[[], Callable[[list[str]], list[Offsets]]]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_tokenizer() -> Callable[[list[str]], list[Offsets]]:
    """Words between ASCII white space, as a tokenizer."""
    return lambda texts: [[m.span() for m in _WORD.finditer(t)] for t in texts]


def truncate_prompt_tokens(prompt, budget: int, factory: TokenizerFactory = word_tokenizer,
                           per_call: int = 1_000) -> Column:
    """The prompt up to the end of its ``budget``-th token (null stays null;
    the tokenizer gets at most ``per_call`` prompts at a time, in Arrow batches)."""
    if budget < 0:
        raise ValueError("a token budget is not negative")

    @F.arrow_udf("string")
    def cut(prompts: pa.Array) -> pa.Array:
        offsets = factory()
        texts, out = prompts.to_pylist(), []
        for k in range(0, len(texts), per_call):
            part = texts[k:k + per_call]
            for text, spans in zip(part, offsets([t or "" for t in part])):
                over = text is not None and len(spans) > budget
                out.append(text[:spans[budget - 1][1] if budget else 0] if over else text)
        return pa.array(out, pa.string())

    return cut(col(prompt))
