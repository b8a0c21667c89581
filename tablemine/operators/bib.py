"""Citation → cited paper: BibTeX title look-up and title matching.

``bib_title_lookup`` finds the entry of a citation tag among a paper's
``.bib`` files; the files are parsed row by row into (tag, title) entries and
joined once with the cited tags.

``title_match`` replaces a remote title search by a join with a paper
metadata table (``arxiv_url``, ``title``).  A pair is accepted when the
macro-F1 of the two token-count vectors is above 0.8.  Candidates are exact:
a pair whose token *sets* differ has class 0 scoring F1 = 0, so it can only
pass when both titles have at least five distinct non-zero token counts
("heavy" titles); ordinary titles are joined on their sorted distinct token
set.  Heavy ones go through a prefix filter: the mean of the classes' F1 is
above the threshold only if one class's is, so the tokens with that count must
overlap, and the rarest of them (by how many titles use a token) must meet.
Class sizes alone bound the macro-F1 from above; only pairs whose bound passes
are scored.  Keys with many titles on both sides are cut into blocks that meet
in pairs, so no task holds more than two blocks of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NO_LINK, TITLE_F1_THRESHOLD
from ..functions.answers import arxiv_id_from_url, year_folder
from ..functions.common import col, starts, strip_ws
from ..session import written
from .lookup import HOT_ROWS, lookup

_ENTRY_KEY = r"^[^\S\n]*@[^\S\n]*[A-Za-z]+[^\S\n]*\{[^\S\n]*([^,\s]+)"
_TITLE = r"(?d)(?<![A-Za-z])title[^\S\n]*=[^\S\n]*\{(.*)\},?"


def bib_entries(bib_files: DataFrame) -> DataFrame:
    """(paper_id, tag, title, head) of every entry of the ``.bib`` files, with
    its opening line, read row by
    row: comment lines (first non-blank char ``%``) go, the text is cut before
    each line that begins with ``@``, and an entry's title is the first one
    before the next entry (NULL if it has none)."""
    text = F.array_join(F.filter(F.split(F.col("content"), "\n"), lambda l: ~starts(strip_ws(l), "%")), "\n")
    cut = F.filter(F.split(text, r"\n(?=[^\S\n]*@)"), lambda e: starts(strip_ws(e), "@"))
    entry = bib_files.select("paper_id", F.explode(cut).alias("entry"))
    title = F.when(F.col("entry").rlike(_TITLE), strip_ws(F.regexp_extract("entry", _TITLE, 1)))
    return entry.select("paper_id", F.regexp_extract("entry", _ENTRY_KEY, 1).alias("tag"), title.alias("title"),
                        F.substring_index("entry", "\n", 1).alias("head"))


def bib_title_lookup(bib_files: DataFrame, citations: DataFrame, tag_col: str = "dataset_citation_tag",
                     containing: bool = False) -> DataFrame:
    """(paper_id, tag, title): the title of the tag's entry, NULL when the
    tag has no entry or more than one, or the entry has no title line.  One
    row-local parse, one join with the cited tags, one count per tag.

    An entry is a tag's when its key equals the tag; with ``containing``, when
    the line that opens it holds the tag anywhere, as the original has it (so
    ``a1`` finds ``a10`` too, and nothing if both are there)."""
    tags = citations.select("paper_id", F.col(tag_col).alias("tag")).distinct()
    entries = bib_entries(bib_files)
    if containing:
        entries = _entries_by_substring(entries, tags)
    found = (tags.join(entries.select("paper_id", "tag", "title"), ["paper_id", "tag"], "left")
             .groupBy("paper_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("t")))
    return found.select("paper_id", "tag", F.when(F.col("n") == 1, F.col("t")).alias("title"))


def _entries_by_substring(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """Entries once for each different substring of their opening line that is
    as long as one of the paper's tags, so that holding a tag is equality: no
    entry is held against all tags of its paper."""
    lengths = tags.groupBy("paper_id").agg(F.collect_set(F.length("tag")).alias("sizes"))
    sized = lookup(entries, lengths, "paper_id", how="inner")
    line = F.col("head")
    cuts = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length(line)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(line) - n + 1), lambda at: F.substr(line, at, n))))
    return sized.select("paper_id", F.explode(F.array_distinct(cuts)).alias("tag"), "title")


# -------------------------------------------------------------- title match
_TOKEN = r"(?U)\b\w\w+\b"


def title_tokens(title) -> Column:
    """Count-vectorizer tokens: lower case, word runs of two or more."""
    return F.regexp_extract_all(F.lower(col(title)), F.lit(_TOKEN), 0)


def token_counts(tokens: Column) -> Column:
    return F.aggregate(tokens, F.create_map().cast("map<string,int>"),
                       lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t),
                                                 F.create_map(t, F.coalesce(m[t], F.lit(0)) + 1)))


def macro_f1(a: Column, b: Column) -> Column:
    """Macro-F1 of two token-count maps over their joint vocabulary, the
    count values acting as class labels (each vocabulary entry is one
    sample)."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    pairs = F.transform(keys, lambda k: F.struct(F.coalesce(a[k], F.lit(0)).alias("x"),
                                                 F.coalesce(b[k], F.lit(0)).alias("y")))
    classes = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["x"]),
                                        F.transform(pairs, lambda p: p["y"])))

    def f1(c):
        tp = F.size(F.filter(pairs, lambda p: (p["x"] == c) & (p["y"] == c)))
        n = F.size(F.filter(pairs, lambda p: p["x"] == c)) + F.size(F.filter(pairs, lambda p: p["y"] == c))
        return F.when(n > 0, 2.0 * tp / n).otherwise(F.lit(0.0))
    scores = F.transform(classes, f1)
    # no tokens at all (empty vocabulary): no score, so never a match
    return F.when(F.size(classes) > 0,
                  F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(classes))


#: Titles of one key in a task, on either side.
KEY_BLOCK = 2_000


def class_sizes(counts: Column) -> Column:
    """How many tokens stand once, twice, ...: map of count to tokens."""
    values = F.map_values(counts)
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(
        v.alias("c"), F.size(F.filter(values, lambda x: x == v)).alias("n"))))


def f1_bound(a: Column, b: Column) -> Column:
    """An upper bound of the macro-F1 from the class sizes of both titles: a
    class scores at most twice the smaller size over the sum, and nothing if
    one title lacks it."""
    classes = F.array_union(F.map_keys(a), F.map_keys(b))
    best = F.transform(classes, lambda c: F.when(a[c].isNotNull() & b[c].isNotNull(),
                                                 2.0 * F.least(a[c], b[c]) / (a[c] + b[c])).otherwise(F.lit(0.0)))
    return F.when(F.size(classes) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(classes))


def _vectors(df: DataFrame, title: Column, side: str) -> DataFrame:
    """``df`` with the count vector of its title, as map and as text."""
    tokens = title_tokens(title)
    counts = df.withColumn(f"{side}_counts", token_counts(tokens))
    entries = F.transform(F.map_entries(f"{side}_counts"), lambda e: F.concat(
        e["key"], F.lit("\u0001"), e["value"].cast("string")))
    return counts.withColumn(f"{side}_canon", F.array_join(F.array_sort(entries), "\u0002"))


def _prefixes(heavy: DataFrame, side: str, order: DataFrame, threshold: float) -> DataFrame:
    """Keys (count, token) of a heavy title: of each class the rarest tokens,
    as many as must hold one of any class with enough in common."""
    each = heavy.select(f"{side}_canon", F.explode(f"{side}_counts").alias("token", "n")).join(order, "token")
    classes = each.groupBy(f"{side}_canon", "n").agg(F.array_sort(F.collect_list(F.struct("titles", "token"))).alias("ts"))
    # F1 above t needs more than t / (2 - t) of the tokens in common
    length = F.size("ts") - F.floor(F.size("ts") * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int")
    return classes.select(f"{side}_canon", F.explode(F.slice("ts", F.lit(1), length)).alias("t"), "n").select(
        f"{side}_canon", F.concat_ws("\u0003", F.lit("n"), F.col("n").cast("string"), "t.token").alias("key"))


def _meet(w: DataFrame, c: DataFrame) -> DataFrame:
    """(w_canon, c_canon) of equal ``key``.  A key that more than ``KEY_BLOCK``
    titles of a side hold is cut into blocks on that side, each of which meets
    each of the other's."""
    counts = w.groupBy("key").agg(F.count(F.lit(1)).alias("nw")).join(
        c.groupBy("key").agg(F.count(F.lit(1)).alias("nc")), "key")
    blocks = counts.select("key", F.ceil(F.col("nw") / KEY_BLOCK).cast("int").alias("bw"),
                           F.ceil(F.col("nc") / KEY_BLOCK).cast("int").alias("bc"))
    blocks = blocks.filter("bw > 1 or bc > 1").checkpoint()
    if blocks.isEmpty():
        return w.join(c, "key").select("w_canon", "c_canon")

    def dealt(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        cut = lookup(rows, blocks, "key").select("key", f"{name}_canon", F.coalesce(own, F.lit(1)).alias("own"),
                                                 F.coalesce(other, F.lit(1)).alias("other"))
        return cut.select("key", f"{name}_canon", F.pmod(F.xxhash64(f"{name}_canon"), "own").cast("int").alias(own),
                          F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias(other))

    return dealt(w, "bw", "bc", "w").join(dealt(c, "bc", "bw", "c"), ["key", "bw", "bc"]).select("w_canon", "c_canon")


def _near(w: DataFrame, c: DataFrame, threshold: float) -> DataFrame:
    """Pairs of heavy titles that share a prefix key."""
    # the rarest token first; any one order for both sides is right
    order = (w.select(F.explode(F.map_keys("w_counts")).alias("token"))
             .unionByName(c.select(F.explode(F.map_keys("c_counts")).alias("token")))
             .groupBy("token").agg(F.count(F.lit(1)).alias("titles")))
    return _meet(_prefixes(w, "w", order, threshold), _prefixes(c, "c", order, threshold))


def title_match(wanted: DataFrame, candidates: DataFrame, wanted_title: str = "title",
                cand_title: str = "title", cand_url: str = "arxiv_url",
                threshold: float = TITLE_F1_THRESHOLD) -> DataFrame:
    """wanted + (arxiv_id, f1) of the best candidate above the threshold
    (ties: smallest URL); braces are removed from the wanted title first.
    Matching runs once per distinct wanted title; rows without a match keep
    NULLs.  Thresholds of 0.8 and above give all pairs.  ``wanted`` is read twice."""
    clean = F.translate(F.col(wanted_title), "{}", "")
    # each title is cut into tokens once, and its rows look it up by its text
    titles = wanted.select(clean.alias("_wt")).filter(F.col("_wt").isNotNull()).groupBy("_wt").count()
    titles = written(_vectors(titles, F.col("_wt"), "w"), "titles")
    # both sides are reduced to distinct count vectors: F1 depends on
    # nothing else, so no set of near-identical titles multiplies the pairs
    w = titles.groupBy("w_canon").agg(F.first("w_counts").alias("w_counts")).checkpoint()
    c = _vectors(candidates.select(F.col(cand_url).alias("_url"), F.col(cand_title).alias("_ct")), F.col("_ct"), "c")
    c = c.groupBy("c_canon").agg(F.min("_url").alias("_url"), F.first("c_counts").alias("c_counts")).checkpoint()

    def token_set(side: str) -> Column:
        return F.concat(F.lit("s"), F.array_join(F.array_sort(F.map_keys(f"{side}_counts")), " "))

    def heavy(side: str) -> Column:
        return F.size(F.array_distinct(F.map_values(f"{side}_counts"))) >= 5

    same = _meet(w.select("w_canon", token_set("w").alias("key")), c.select("c_canon", token_set("c").alias("key")))
    hw, hc = w.filter(heavy("w")), c.filter(heavy("c"))
    if hw.isEmpty() or hc.isEmpty():  # an ordinary title has no partner beside its set
        pairs = same
    else:
        pairs = same.unionByName(_near(hw, hc, threshold)).distinct()
    sized = (pairs.join(w.select("w_canon", "w_counts"), "w_canon").join(c, "c_canon")
             .filter(f1_bound(class_sizes(F.col("w_counts")), class_sizes(F.col("c_counts"))) > threshold))
    scored = sized.withColumn("f1", macro_f1(F.col("c_counts"), F.col("w_counts"))).filter(F.col("f1") > threshold)
    # best score first, then the smallest URL: one partial aggregate
    best = (scored.groupBy("w_canon")
            .agg(F.min(F.struct((-F.col("f1")).alias("nf"), F.col("_url").alias("u"))).alias("b"))
            .select("w_canon", F.col("b.u").alias("_url"), (-F.col("b.nf")).alias("f1")))
    matches = titles.select("_wt", "w_canon").join(best, "w_canon").select("_wt", "_url", "f1")
    hot = titles.filter(F.col("count") > HOT_ROWS).select("_wt")
    out = lookup(wanted.withColumn("_wt", clean), matches, "_wt", hot=hot)
    return out.select(*wanted.columns, arxiv_id_from_url(F.col("_url")).alias("arxiv_id"), "f1")


def link_columns(records: DataFrame, matched: DataFrame | None, key_cols: list[str],
                 source_root: str) -> DataFrame:
    """Append dataset_link (arXiv id) and external_source_path; '' when any
    step failed (tag ``xx``, unknown year folder, no title, no match).
    ``matched`` has an ``arxiv_id`` for each key; without it the records bring
    their own, as ``title_match`` returns them, and nothing is joined."""
    if matched is None:
        out = records.withColumnRenamed("arxiv_id", "_aid")
    else:
        out = lookup(records, matched.select(*key_cols, F.col("arxiv_id").alias("_aid")), key_cols)
    ok = F.col("_aid").isNotNull() & year_folder("paper_id").isNotNull()
    return (out.withColumn("dataset_link", F.when(ok, F.col("_aid")).otherwise(F.lit(NO_LINK)))
            .withColumn("external_source_path",
                        F.when(ok, F.concat(F.lit(source_root.rstrip("/") + "/"), F.col("_aid")))
                         .otherwise(F.lit(NO_LINK)))
            .drop("_aid"))
