"""Table labels and multi-tabular blocks (array functions on a block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col, count_sub, let
from .blocks import tabular_spans

_LABEL = r"(?s)\\label\s*\{.*?\}"
_LABEL_INNER = r"(?s)\\label\s*\{(.*?)\}"


def table_labels(block) -> Column:
    """All ``\\label{…}`` strings of a block, in order."""
    return F.regexp_extract_all(col(block), F.lit(_LABEL), 0)


def most_referenced(labels: Column, paper: Column, all_tables: Column) -> Column:
    """The label whose ``\\ref{…}`` occurs most often in the paper outside
    the tables (ties: first)."""
    scored = F.transform(labels, lambda l, i: F.struct(
        (-(count_sub_col(paper, F.replace(l, F.lit("label"), F.lit("ref")))
           - count_sub_col(all_tables, F.replace(l, F.lit("label"), F.lit("ref"))))).alias("neg"),
        i.alias("i"), l.alias("l")))
    return F.array_min(scored)["l"]


def count_sub_col(text: Column, sub: Column) -> Column:
    """Occurrences of a (column) substring."""
    return F.when(F.length(sub) > 0,
                  (F.length(text) - F.length(F.replace(text, sub, F.lit("")))) / F.length(sub)) \
            .otherwise(F.lit(0)).cast("int")


def resolve_table_label(table, paper, all_tables, enclosing=None) -> Column:
    """Label of a table: 1 label → it; more → the most referenced one; none →
    the only label of the ``enclosing`` block (NULL if it has none or several,
    or no enclosing block is given)."""
    labels = table_labels(table)
    found = F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).when(
        F.size(labels) > 1, most_referenced(labels, col(paper), col(all_tables)))
    if enclosing is None:
        return found
    outer = table_labels(enclosing)
    return found.when((F.size(labels) == 0) & (F.size(outer) == 1), F.get(outer, F.lit(0)))


def split_multi_tabular(blocks: DataFrame, block_col: str = "table_source",
                        all_blocks_col: str = "all_tables") -> DataFrame:
    """One row per tabular piece: a block with one tabular stays whole
    (label: its only label, else the first label occurring once among all
    blocks); with several it is split per tabular, or per ``\\subfloat``
    (from the i-th ``\\subfloat`` to the end of the i-th tabular) when the
    counts agree; a piece's label is its own (inner text) if it has one,
    else the block's only label."""
    b = F.col(block_col)
    spans = tabular_spans(block_col)
    block_labels = table_labels(b)
    joined = F.array_join(F.col(all_blocks_col), " ")
    single_label = F.when(F.size(block_labels) == 1, block_labels[0]).when(
        F.size(block_labels) > 1,
        F.filter(block_labels, lambda l: count_sub_col(joined, l) == 1)[0])

    def pieces(sp):
        n_sub = count_sub(b, "\\subfloat")
        by_subfloat = F.transform(_span_ends(b, sp), lambda end, i: F.substr(
            b, _nth_locate(b, "\\subfloat", i + 1), end - _nth_locate(b, "\\subfloat", i + 1)))
        chosen = F.when(F.size(sp) == n_sub, by_subfloat).otherwise(sp)
        return F.transform(chosen, lambda piece: F.struct(
            piece.alias("piece"),
            F.when(F.size(F.regexp_extract_all(piece, F.lit(_LABEL_INNER), 1)) == 1,
                   F.regexp_extract_all(piece, F.lit(_LABEL_INNER), 1)[0])
             .when(F.size(block_labels) == 1, block_labels[0]).alias("label")))

    arr = let(spans, lambda sp: F.when(F.size(sp) == 1, F.array(F.struct(
        b.alias("piece"), single_label.alias("label")))).otherwise(pieces(sp)))
    keep = [c for c in blocks.columns]
    return blocks.select(*keep, F.posexplode(arr).alias("piece_index", "p")) \
                 .select(*keep, "piece_index", F.col("p.piece").alias("piece"), F.col("p.label").alias("label"))


def _span_ends(text: Column, spans: Column) -> Column:
    """1-based position after each span: spans lie one after the other, so each
    is searched behind the one before (equal spans keep their own places)."""
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(acc, s):
        rest = F.substr(text, acc["at"], F.length(text))
        return let(acc["at"] + F.instr(rest, s) - 1 + F.length(s),
                   lambda end: F.struct(end.alias("at"), F.array_append(acc["ends"], end).alias("ends")))

    return F.aggregate(spans, init, step)["ends"]


def _nth_locate(text: Column, sub: str, n: Column) -> Column:
    """1-based position of the n-th occurrence of ``sub`` (0 if fewer)."""
    parts = F.split(text, _quote(sub))
    head = F.slice(parts, 1, n)
    return F.when(F.size(parts) > n,
                  F.aggregate(head, F.lit(0), lambda a, p: a + F.length(p)) + (n - 1) * len(sub) + 1) \
            .otherwise(F.lit(0))


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


_LABEL_OR_TAB = (r"(\\begin\s*?\{\s*?tabular[^\n]*?\}|\\end\s*?\{\s*?tabular[^\n]*?\}"
                 r"|\\label\s*\{[^}]*\})")


def nearest_label_after(block) -> Column:
    """array<string>: for each outermost tabular of the block, in order, the
    first ``\\label{…}`` after it with no other tabular starting in between
    (NULL when there is none).  One fold over the block's tabular and label
    tokens."""
    marked = F.regexp_replace(col(block), _LABEL_OR_TAB, "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.lit(False).alias("pending"),
                    F.array().cast("array<string>").alias("out"))

    def step(a, p):
        tok = (a["i"] % 2) == 1
        is_begin = tok & F.startswith(p, F.lit("\\begin"))
        is_end = tok & F.startswith(p, F.lit("\\end"))
        is_label = tok & F.startswith(p, F.lit("\\label"))
        d = a["d"] + F.when(is_begin, 1).when(is_end, -1).otherwise(0)
        closes = is_end & (d == 0)
        take = a["pending"] & is_label & (a["d"] == 0)
        # a pending tabular with no label before the next tabular gets NULL
        give_up = a["pending"] & is_begin & (a["d"] == 0)
        out = (F.when(take, F.array_append(a["out"], p))
                .when(give_up, F.array_append(a["out"], F.lit(None).cast("string")))
                .otherwise(a["out"]))
        pending = F.when(closes, F.lit(True)).when(take | give_up, F.lit(False)).otherwise(a["pending"])
        return F.struct((a["i"] + 1).alias("i"), d.alias("d"), pending.alias("pending"), out.alias("out"))

    return let(F.aggregate(pieces, init, step), lambda r: F.when(
        r["pending"], F.array_append(r["out"], F.lit(None).cast("string"))).otherwise(r["out"]))
