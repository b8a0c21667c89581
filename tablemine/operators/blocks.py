"""Table blocks out of a paper's LaTeX.

All work here is row-local: a paper is one row, its blocks are an array
column built with ``regexp_extract_all`` and higher-order functions, so
nothing is shuffled and the operators are valid on a streaming DataFrame.
``papers_with_tables`` is the only generator (``posexplode``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TABLE_PREFIX_KIND, WRAPPING_KINDS
from ..functions.common import count_sub, col, kept_apart, let

# A block runs from its begin tag, lazily, to the first end tag of the
# same kind and then to the next closing brace (DOTALL).
_PREFIX_PATTERN = (r"(?s)\\begin\s*?\{\s*?" + TABLE_PREFIX_KIND + r".*?\\end\s*?\{\s*?"
                   + TABLE_PREFIX_KIND + r".*?\}")
_ROTATING_KINDS = {"wraptable", "sidewaystable"}


def _kind_pattern(kind: str) -> str:
    if kind in _ROTATING_KINDS:
        return r"(?s)\\begin\s*?\{\s*?" + kind + r".*?" + kind + r".*?\}"
    return r"(?s)\\begin\s*?\{" + kind + r".*?\\end\s*?\{" + kind + r".*?\}"


def raw_table_blocks(text: Column) -> Column:
    """All candidate blocks in search order (before dedupe / repair)."""
    parts = [F.regexp_extract_all(text, F.lit(_PREFIX_PATTERN), 0)]
    for kind in WRAPPING_KINDS:
        found = F.regexp_extract_all(text, F.lit(_kind_pattern(kind)), 0)
        parts.append(F.filter(found, lambda b: F.contains(b, F.lit("\\begin{tabular"))
                              & F.contains(b, F.lit("\\end{tabular"))))
    return F.concat(*parts)


def drop_contained_blocks(blocks: Column) -> Column:
    """Drop blocks that are substrings of a strictly longer block of the
    same paper; equal copies all stay."""
    return let(blocks, lambda bs: F.filter(bs, lambda x: ~F.exists(
        bs, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x))))


def strip_line_comments(text: Column) -> Column:
    """Cut each line at its first '%', unless an escaped ``\\%`` comes first
    (and no ``\\\\%`` occurs in the line)."""
    def per_line(line):
        p = F.instr(line, "%")
        e = F.instr(line, "\\%")
        cut = (p > 0) & ((e == 0) | (e > p) | (F.instr(line, "\\\\%") > 0))
        return F.when(cut, F.substr(line, F.lit(1), p - 1)).otherwise(line)
    return F.array_join(F.transform(F.split(text, "\n"), per_line), "\n")


def braces_balanced(text: Column) -> Column:
    """Equal brace counts, or equal once escaped braces are discounted."""
    o, c = count_sub(text, "{"), count_sub(text, "}")
    return (o == c) | ((o - count_sub(text, "\\{")) == (c - count_sub(text, "\\}")))


_REPAIR_TOKENS = r"(?s)begin\{|end\{|\{|\}|(?:(?!begin\{|end\{)[^{}])+"


def repair_block(block: Column, paper: Column) -> Column:
    """Balance an unbalanced block by extending it to the right.

    The block is located in the paper (first occurrence); from its end the
    text is scanned until brace depth returns to 0 with as many
    ``begin{`` as ``end{`` in the extended span.  A block that cannot be
    found, or whose own depth is not positive, is dropped (NULL); one that
    never closes stays as it is.  The scan is token-wise (brace tokens and
    runs of other text), not per character, and only runs for unbalanced
    blocks.
    """
    def scan_from(b, start):
        depth0 = count_sub(b, "{") - count_sub(b, "}")
        rest = F.substr(paper, start + F.length(b), F.length(paper))
        toks = F.regexp_extract_all(rest, F.lit(_REPAIR_TOKENS), 0)
        init = F.struct(F.lit(0).alias("pos"), depth0.alias("d"),
                        count_sub(b, "begin{").alias("nb"), count_sub(b, "end{").alias("ne"),
                        F.lit(-1).alias("found"))

        def step(a, t):
            is_b = t == F.lit("begin{")
            is_e = t == F.lit("end{")
            d = a["d"] + F.when(is_b | is_e | (t == F.lit("{")), 1).when(t == F.lit("}"), -1).otherwise(0)
            nb = a["nb"] + F.when(is_b, 1).otherwise(0)
            ne = a["ne"] + F.when(is_e, 1).otherwise(0)
            pos = a["pos"] + F.length(t)
            # plain-text runs change nothing, so the first hit is always right
            # after a brace-bearing token, exactly where a per-char scan stops
            hit = (a["found"] < 0) & (d == 0) & (nb == ne)
            return F.struct(pos.alias("pos"), d.alias("d"), nb.alias("nb"), ne.alias("ne"),
                            F.when(hit, pos).otherwise(a["found"]).alias("found"))

        found = F.when((start == 0) | (depth0 <= 0), F.lit(-2)).otherwise(
            F.aggregate(toks, init, step)["found"])
        return let(found, lambda f: (
            F.when(f == -2, F.lit(None).cast("string"))
             .when(f >= 0, F.substr(paper, start, F.length(b) + f))
             .otherwise(b)))

    return let(block, lambda b: F.when(braces_balanced(b), b).otherwise(
        let(F.instr(paper, b), lambda start: scan_from(b, start))))


def table_blocks(text) -> Column:
    """The table blocks of one paper, as an array of LaTeX strings:
    extract, drop contained, strip comments, repair braces, drop contained."""
    text = col(text)
    first = drop_contained_blocks(raw_table_blocks(text))
    cleaned = F.transform(first, lambda b: repair_block(strip_line_comments(b), text))
    return drop_contained_blocks(F.filter(cleaned, lambda b: b.isNotNull()))


def extract_table_blocks(papers: DataFrame, text_col: str = "full_paper_latex_code",
                         out_col: str = "tables") -> DataFrame:
    """Add ``tables``: array of the paper's table blocks."""
    return papers.withColumn(out_col, table_blocks(text_col))


def papers_with_tables(papers: DataFrame, tables_col: str = "tables",
                       text_col: str = "full_paper_latex_code") -> DataFrame:
    """One row per (paper, table) with the table ordinal; papers with no
    body text or no tables vanish."""
    # posexplode yields nothing for an empty or NULL array; a size filter, also
    # one that Spark infers, would recompute the blocks below the projection
    keep = [c for c in papers.columns if c != tables_col]
    return papers.select(*keep, F.posexplode(kept_apart(F.col(tables_col))).alias("table_index", "table_source"))


# ----------------------------------------------------------------- tabulars
_TAB_TOKEN = r"(\\begin\s*?\{\s*?tabular[^\n]*?\}|\\end\s*?\{\s*?tabular[^\n]*?\})"
_SENTINEL = "\u0001"


def balanced_spans(text: Column, begin_prefix: str = "\\begin",
                   token_pattern: str = _TAB_TOKEN) -> Column:
    """Outermost balanced begin/end spans of ``text`` (default: tabular).

    Tokens are cut out with a sentinel and the piece list is folded with a
    depth counter.  End-first, unclosed or over-closed token lists give an
    empty array.
    """
    marked = F.regexp_replace(text, token_pattern, _SENTINEL + "$1" + _SENTINEL)
    pieces = F.split(marked, _SENTINEL)
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.lit("").alias("buf"),
                    F.array().cast("array<string>").alias("out"), F.lit(False).alias("bad"))

    def step(a, p):
        is_tok = (a["i"] % 2) == 1
        is_begin = is_tok & F.startswith(p, F.lit(begin_prefix))
        is_end = is_tok & ~is_begin
        d = a["d"] + F.when(is_begin, 1).when(is_end, -1).otherwise(0)
        inside = (a["d"] > 0) | is_begin
        buf = F.when(is_begin & (a["d"] == 0), p).when(inside, F.concat(a["buf"], p)).otherwise(a["buf"])
        closed = is_end & (d == 0) & (a["d"] == 1)
        out = F.when(closed, F.array_append(a["out"], buf)).otherwise(a["out"])
        return F.struct((a["i"] + 1).alias("i"), d.alias("d"),
                        F.when(closed, F.lit("")).otherwise(buf).alias("buf"),
                        out.alias("out"), (a["bad"] | (d < 0)).alias("bad"))

    return let(F.aggregate(pieces, init, step), lambda res: F.when(
        res["bad"] | (res["d"] != 0), F.array().cast("array<string>")).otherwise(res["out"]))


def tabular_spans(table_source) -> Column:
    """Outermost ``tabular`` environments of a table block."""
    return balanced_spans(col(table_source))


_SNIPPET_TOKENS = r"(?s)end\{|\{|\}|(?:(?!end\{)[^{}])+"


def command_snippets(text, command: str) -> Column:
    """From each ``\\<command>`` to the first point where brace depth is
    back to 0 with an ``end{`` inside the span (e.g. ``\\subfloat{…}``
    around a tabular).  Occurrences that never close give nothing.  The scan
    is token-wise (``end{``, braces, runs of other text): plain runs change
    neither depth nor the ``end{`` flag, so the first stop is always right
    after a brace-bearing token, where a per-character scan stops too."""
    t = col(text)
    occurrence = r"\\\s*" + command
    pieces = F.split(t, "(?=" + occurrence + ")")

    def snippet(suffix):
        toks = F.regexp_extract_all(F.substr(suffix, F.lit(2), F.length(suffix)),
                                    F.lit(_SNIPPET_TOKENS), 0)
        init = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("d"), F.lit(False).alias("seen_end"),
                        F.lit(-1).alias("found"))

        def step(a, tok):
            d = a["d"] + F.when(F.endswith(tok, F.lit("{")), 1).when(tok == F.lit("}"), -1).otherwise(0)
            seen = a["seen_end"] | (tok == F.lit("end{"))
            pos = a["pos"] + F.length(tok)
            hit = (a["found"] < 0) & (d == 0) & seen
            return F.struct(pos.alias("pos"), d.alias("d"), seen.alias("seen_end"),
                            F.when(hit, pos).otherwise(a["found"]).alias("found"))
        f = F.aggregate(toks, init, step)["found"]
        return F.when(f > 0, F.substr(suffix, F.lit(1), f))

    # the text from each occurrence to the end
    starts_here = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                           lambda s: s["p"].rlike("^" + occurrence))
    suffixes = F.transform(starts_here,
                           lambda s: F.array_join(F.slice(pieces, s["i"] + 1, F.size(pieces)), ""))
    return F.filter(F.transform(suffixes, snippet), lambda s: s.isNotNull())
