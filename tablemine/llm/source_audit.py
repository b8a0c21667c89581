"""Audit of how sources diverge, over a group-term count matrix.

Rows of the matrix are the (lang, source) groups, columns the terms that enough
documents of the language use, cells the occurrences.  Columns are dealt over
tasks in blocks (and rows, where a language has very many sources, in tiles).
Each task holds its block as a K-squared quadtree: the nonzero quadrants of
each level, from single cells up to the whole block.  For all pairs of groups
at once the trees are walked from the top.  Where both groups' quadrants are
empty every term adds the same amount, which follows from the two totals; it is
multiplied out, not walked.  Only quadrants that one of the two fills are
divided further, down to the cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, parts_for, read, slices

#: A term is kept in a language from this many of its documents on; ranks of
#: part ``term``.
MIN_DOCS, TOP_TERMS = 10, 10
#: Columns of a block, rows of a tile.
BLOCK_TERMS, TILE_GROUPS = 4_096, 256
#: Distinct (group, term) pairs a task counts before it sends them on, and
#: quadrants of pairs it divides at a time.
COUNTED, FRONTIER = 300_000, 1 << 20

#: Bytes of terms stay (capitals as small letters), all others part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and of characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


# -- counting -------------------------------------------------------------

def term_counts(docs: DataFrame, column: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents of each term of
    each group; a group's row with a null term says that it occurs."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang, "lang"), (source, "source"), (column, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        since = 0
        for part in slices(batches, "text"):
            groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
            for group, text in zip(groups, as_bytes(part.column("text"))):
                terms = terms_of(text)
                if group not in held:
                    held[group] = Counter(), Counter()
                n, d = held[group]
                before = len(d)
                n.update(terms)
                d.update(set(terms))
                since += len(d) - before
                if since >= COUNTED:
                    yield from flush(held)
                    held, since = {}, 0
        yield from flush(held)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang_, source_), (n, d) in held.items():
            terms = [*n, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang_] * len(terms), pa.string()), pa.array([source_] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()),
                 pa.array([*(d[t] for t in n), 0], pa.int64())], ["lang", "source", "term", "n", "d"])

    found = clean.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


# -- the tree and the walk over it ----------------------------------------

def quadtree(row: np.ndarray, col: np.ndarray, levels: int) -> list[np.ndarray]:
    """Nonzero quadrants, level by level from the cells up: sorted codes
    ``row << 32 | column`` of quadrants 1, 2, 4, ... cells wide."""
    code = np.unique(row << 32 | col)
    out = [code]
    for _ in range(levels):
        code = np.unique(code >> 33 << 32 | (code & 0xFFFFFFFF) >> 1)
        out.append(code)
    return out


def find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands, and whether it does."""
    if not len(sorted_codes):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * count / total)`` in exact whole numbers (``count``
    at most ``total``, both below 9e15): three digits a step."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))``; below 2**63 as p and q are at most 10**9 + 1."""
    return (p - q) ** 2 // (p + q)


def walk(row: np.ndarray, col: np.ndarray, count: np.ndarray, totals: np.ndarray, first: np.ndarray, second: np.ndarray,
         columns: int) -> np.ndarray:
    """Sums of the gaps over all columns of a block, for each group of
    ``first`` with each of ``second``.

    ``row, col, count``: the nonzero cells; ``totals``: N + 2 V of each row.
    """
    size = max(len(totals), columns, 1)
    levels = int(size - 1).bit_length()
    tree = quadtree(row, col, levels)
    order = np.argsort(row << 32 | col)
    count = count[order]
    n = len(totals)
    a_rows, b_rows = np.zeros(n, bool), np.zeros(n, bool)
    a_rows[first], b_rows[second] = True, True
    sums = np.zeros((n, n), np.int64)
    # columns in which a quadrant of rows has nothing with another, by level
    empty = [np.zeros((((n - 1) >> k) + 1,) * 2, np.int64) for k in range(levels + 1)]
    wanted = []
    for k in range(levels + 1):
        w = np.zeros((2, ((n - 1) >> k) + 1), bool)
        w[0, np.flatnonzero(a_rows) >> k] = True
        w[1, np.flatnonzero(b_rows) >> k] = True
        wanted.append(w)
    stack = [(levels, *np.zeros((3, 1), np.int64))]
    while stack:
        k, i, j, c = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(k, i[half:], j[half:], c[half:]), (k, i[:half], j[:half], c[:half])]
            continue
        at_i, in_i = find(tree[k], i << 32 | c)
        at_j, in_j = find(tree[k], j << 32 | c)
        none = ~in_i & ~in_j
        width = np.clip(columns - (c[none] << k), 0, 1 << k)
        np.add.at(empty[k], (i[none], j[none]), width)
        go = ~none
        i, j, c = i[go], j[go], c[go]
        if k == 0:
            x = np.where(in_i[go], count[at_i[go]], 0)
            y = np.where(in_j[go], count[at_j[go]], 0)
            np.add.at(sums, (i, j), gap(shares(x + 2, totals[i]), shares(y + 2, totals[j])))
            continue
        if not len(i):
            continue
        i, j, c = (np.concatenate([2 * v + (s >> bit & 1) for s in range(8)]) for v, bit in ((i, 2), (j, 1), (c, 0)))
        rows = wanted[k - 1]
        inside = (i < rows.shape[1]) & (j < rows.shape[1]) & (c << (k - 1) < columns)
        i, j, c = i[inside], j[inside], c[inside]
        some = rows[0, i] & rows[1, j]
        stack.append((k - 1, i[some], j[some], c[some]))
    zeros = empty[0]
    at = np.arange(n)
    for k in range(1, levels + 1):
        zeros += empty[k][np.ix_(at >> k, at >> k)]
    bare = shares(np.full(n, 2, np.int64), totals)
    return (sums + zeros * gap(bare[:, None], bare[None, :]))[np.ix_(first, second)]


# -- the audit ------------------------------------------------------------

FOUND = "lang string, source string, part string, item string, value long"


def source_divergence(docs: DataFrame, column: str = "text", lang: str = "lang", source: str = "source",
                      min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group the other
    sources of its language by divergence (part ``pair``), and the terms it
    uses more than its language does (part ``term``, the first ``top``).

    Null text, lang and source count as empty; a group without any kept term
    takes part; a language of one source has no pairs; equal values rank by
    item; repeated rows count each; an empty table gives no rows.
    """
    counts = checkpointed(term_counts(docs, column, lang, source))
    groups = counts.where("term is null").select("lang", "source")
    terms = checkpointed(counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("d").alias("d"), F.sum("n").alias("all_n"),
        F.collect_list(F.struct("source", "n")).alias("cells")).where(F.col("d") >= min_docs).drop("d"))
    # the driver learns three numbers: kept terms, and sources of the widest language
    blocks = parts_for(terms.count(), BLOCK_TERMS)
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = parts_for(widest, TILE_GROUPS)

    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    placed = terms.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("columns"), F.sum("all_n").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("columns").alias("v"), F.sum("n").alias("lang_n"))
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(
        F.sum("c.n").alias("n"))
    zero = F.lit(0).cast("long")
    known = (groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
             .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"),
                     F.coalesce("lang_n", zero).alias("lang_n"), tile(F.col("source")).alias("tile")))
    known = known.join(sizes.select("lang", "block", "columns"), "lang", "left").withColumn(
        "block", F.coalesce("block", F.lit(0))).withColumn("columns", F.coalesce("columns", zero))
    pairs = F.expr(f"transform(sequence(0, {tiles - 1}), u -> struct(least(tile, u) as a, greatest(tile, u) as b))")
    left = known.withColumn("ab", F.explode(pairs)).select("*", "ab.a", "ab.b").drop("ab")
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(tiles) for b in range(a, tiles)]) \
        if tiles <= 4 else F.expr(f"flatten(transform(sequence(0, {tiles - 1}), a -> transform(sequence(a, {tiles - 1}), "
                                  "b -> struct(a as a, b as b))))")
    right = placed.withColumn("ab", F.explode(both)).withColumn(
        "cells", F.filter("cells", lambda c: tile(c["source"]).isin(F.col("ab.a"), F.col("ab.b")))).where(
        F.size("cells") > 0).select("lang", "block", "ab.a", "ab.b", "term", "all_n", "cells.source", "cells.n")

    def run(known: pa.Table, cells: pa.Table) -> pa.Table:
        if not known.num_rows:
            return _rows([])
        known = known.sort_by("source")
        key = {k: known.column(k)[0].as_py() for k in ("lang", "a", "b", "v", "lang_n", "columns")}
        names = known.column("source").to_pylist()
        totals = known.column("n").to_numpy() + 2 * key["v"]
        tile_of = known.column("tile").to_numpy()
        first, second = (np.flatnonzero(tile_of == key[k]) for k in ("a", "b"))
        number = {s: k for k, s in enumerate(names)}
        cells = cells.sort_by("term")
        terms = cells.column("term").to_pylist()
        lists = cells.column("source").to_pylist()
        row = np.array([number[s] for x in lists for s in x], np.int64)
        col = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
        count = np.array([n for x in cells.column("n").to_pylist() for n in x], np.int64)
        out = []
        if key["v"]:
            value = walk(row, col, count, totals, first, second, key["columns"])
        else:
            value = np.zeros((len(first), len(second)), np.int64)
        for x, i in enumerate(first.tolist()):
            for y, j in enumerate(second.tolist()):
                if key["a"] != key["b"] or i < j:
                    out.append((key["lang"], names[i], "pair", names[j], int(value[x, y])))
        if key["a"] == key["b"] and len(row):
            p = shares(count + 2, totals[row])
            whole = cells.column("all_n").to_numpy()
            q = shares(whole + 2, np.full(len(whole), key["lang_n"] + 2 * key["v"], np.int64))[col]
            f = gap(p, q)
            above = np.flatnonzero(p > q)
            # the first of each group in this block
            above = above[np.lexsort((col[above], -f[above], row[above]))]
            start = np.searchsorted(row[above], row[above])
            above = above[np.arange(len(above)) - start < top]
            out += [(key["lang"], names[row[k]], "term", terms[col[k]], int(f[k])) for k in above.tolist()]
        return _rows(out)

    # both sides come from the same tables: name the columns anew
    left, right = (x.toDF(*x.columns).groupBy("lang", "block", "a", "b") for x in (left, right))
    found = checkpointed(left.cogroup(right).applyInArrow(run, FOUND))
    once = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mirrored = once.select("lang", "value", F.explode(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    pair = mirrored.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    everything = pair.unionByName(found.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return everything.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select(
        "lang", "source", "part", "item", "value", "rank")


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("lang", "source", "part", "item", "value"), cols, kinds)})


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all ``documents``."""
    return source_divergence(read(spark, sf_dir, "documents"))


#: The same with every (group, kept term) cell listed.
OP12_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, doc_id, row_number() over () as r,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     t as (select lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
     k as (select lang, term, count(*) as all_n from t group by lang, term having count(distinct r) >= 10),
     g as (select distinct lang, source from d),
     c as (select lang, source, term, count(*) as n from t group by lang, source, term),
     v as (select lang, count(*) as v, sum(all_n) as lang_n from k group by lang),
     m as (select g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) as n from g join k on g.lang = k.lang
           left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
     s as (select lang, source, sum(n) as total from m group by lang, source),
     p as (select m.lang, m.source, m.term, m.n,
                  1 + (1000000000::hugeint * (m.n + 2)) // (s.total + 2 * v.v) as p,
                  1 + (1000000000::hugeint * (m.all_n + 2)) // (v.lang_n + 2 * v.v) as q
           from m join s on m.lang = s.lang and m.source = s.source join v on m.lang = v.lang),
     pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
               from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
     both_parts as (
       select g.lang, g.source, 'pair' as part, h.source as item, coalesce(pairs.value, 0)::bigint as value
       from g join g h on g.lang = h.lang and g.source <> h.source
       left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source
       union all
       select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q),
     ranks as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from both_parts)
select lang, source, part, item, value, r::int as "rank" from ranks where part = 'pair' or r <= 10
"""
