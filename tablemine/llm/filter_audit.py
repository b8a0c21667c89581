"""Audit of how quality filters interact, with a counting-Bloom prepass.

Five filters judge each document; the fifth (a copy of a text with a smaller
id) needs the whole table.  A first pass sends only hashes: each task counts
them into a sketch of small saturating counters, the sketches are added up
segment by segment, and a text one of whose counters stayed below two is
certainly the only one.  The second pass judges the other four filters and
lets only the texts that may repeat go on; those are grouped by their full
text for their smallest id.  The flags of all filters then join by id into a
mask, and counts by (part, mask) hold all that any order of the filters needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, mix, read, slices

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Sketch: counters for each text, hash functions, counters of a segment.  The
#: merged sketch (a bit a counter) is broadcast; ``MAX_SLOTS`` bounds it (128
#: MB).  Beyond it more unique texts pass as possible repeats, which costs
#: their shuffle but changes no result.
SLOTS_PER_TEXT, HASHES, SEGMENT_SLOTS, MAX_SLOTS = 12, 3, 1 << 20, 1 << 30
#: Hashes that a task counts before it sends them on.
COUNTED = 1 << 19

_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails (bit k: the k-th)."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


# -- sketch ---------------------------------------------------------------

def slots_for(rows: int) -> int:
    return min(max(SLOTS_PER_TEXT * rows, 1 << 12), MAX_SLOTS)


def places(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The counters of each hash, one in each of ``HASHES`` equal slices."""
    part = slots // HASHES
    out = np.empty((len(hashes), HASHES), np.int64)
    for k in range(HASHES):
        own = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)))
        out[:, k] = k * part + (own % np.uint64(part)).astype(np.int64)
    return out


def repeat_sketch(hashes: DataFrame, slots: int) -> np.ndarray:
    """Bits of the counters that reached two, of a one-column table of hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= COUNTED:
                yield sketch(np.concatenate(held))
                held, n = [], 0
        if n:
            yield sketch(np.concatenate(held))

    def sketch(values: np.ndarray) -> pa.RecordBatch:
        at, n = np.unique(places(values, slots), return_counts=True)
        edges = np.searchsorted(at, np.arange(0, slots + SEGMENT_SLOTS, SEGMENT_SLOTS))
        rows = [(k, (at[a:b] - k * SEGMENT_SLOTS).astype(np.uint32).tobytes(), np.packbits(n[a:b] > 1).tobytes())
                for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))],
            ["segment", "places", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment; one segment's counters are held at a time."""
        now, counters = None, np.zeros(SEGMENT_SLOTS, np.uint8)
        for batch in batches:
            for k, at, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if now is not None:
                        yield done(now, counters)
                    now = k
                    counters[:] = 0
                at = np.frombuffer(at, np.uint32)
                more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)) + np.uint8(1)
                counters[at] = np.minimum(counters[at] + more, 2)
        if now is not None:
            yield done(now, counters)

    def done(segment: int, counters: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(counters > 1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits], pa.binary())],
                                          ["segment", "bits"])

    sketches = hashes.mapInArrow(count, "segment int, places binary, twice binary")
    merged = sketches.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(-(-slots // SEGMENT_SLOTS) * SEGMENT_SLOTS // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment * SEGMENT_SLOTS // 8:(row.segment + 1) * SEGMENT_SLOTS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def may_repeat(hashes: np.ndarray, bits: np.ndarray, slots: int) -> np.ndarray:
    """False where a hash is certainly the only one."""
    at = places(hashes, slots)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


# -- flags and counts -----------------------------------------------------

def document_masks(docs: DataFrame, id_column: str = "doc_id", column: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of each row: bit k is set if the row fails the
    k-th filter.  Null text and part count as empty.  A row without an id is a
    copy of nothing smaller and nothing's original; of rows with one id and
    one text none is the other's copy."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h"))
    slots = slots_for(docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(repeat_sketch(rows.select("h"), slots))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            mask = pa.array([failures(t) for t in texts], pa.int32())
            maybe = may_repeat(batch.column("h").to_numpy().view(np.uint64), shared.value, slots)
            left = pa.array([t if m else None for t, m in zip(texts, maybe.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), mask, batch.column("h"), left.cast(pa.string())],
                ["doc_id", "part", "mask", "h", "repeat"])

    judged = checkpointed(rows.mapInArrow(judge, "doc_id long, part string, mask int, h long, repeat string"))
    # full texts, grouped where they stand first: a text in a third of all rows is one row a task
    first = judged.where("repeat is not null and doc_id is not null").groupBy("repeat", "h").agg(
        F.min("doc_id").alias("_first")).select("_first", F.col("h").alias("_h"))
    slim = judged.select("doc_id", "part", "mask", "h", F.col("repeat").isNotNull().alias("maybe"))
    named = slim.where("doc_id is not null").join(
        first, (F.col("doc_id") == F.col("_first")) & (F.col("h") == F.col("_h")), "left")
    copy = F.when(F.col("maybe") & F.col("_first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    named = named.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    return named.unionByName(slim.where("doc_id is null").select("doc_id", "part", "mask"))


def _kinds() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """All (order, step, filter) and, for each count, which masks count there."""
    steps = [("".join(order), s + 1, FILTERS.index(f)) for order in permutations(FILTERS) for s, f in enumerate(order)]
    masks = np.arange(1 << len(FILTERS))
    out = {k: np.zeros((len(steps), len(masks)), bool) for k in ("kept", "removed", "redundant", "alone")}
    for i, (order, s, f) in enumerate(steps):
        before = sum(1 << FILTERS.index(x) for x in order[:s - 1])
        fails, gone = masks >> f & 1 > 0, masks & before > 0
        out["kept"][i] = ~fails & ~gone
        out["removed"][i] = fails & ~gone
        out["redundant"][i] = fails & gone
        out["alone"][i] = masks == 1 << f
    return steps, out


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def filter_interactions(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text",
                        part: str = "source") -> DataFrame:
    """For each part, order of the filters and step, how many documents stay,
    go, would have gone anyway, fail this filter alone; how many good and toxic
    ones go; and the filter's removals summed over all orders.

    Rows of an empty table: none.  Repeated rows count each; an id that
    ``labels`` names several times is good or toxic if one of them says so;
    further columns are ignored.
    """
    masks = document_masks(docs, id_column, column, part)
    said = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").where("_id is not null")
    said = said.groupBy("_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                   F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    flagged = masks.where("doc_id is not null").join(said, F.col("doc_id") == F.col("_id"), "left").select(
        "part", "mask", "good", "bad").unionByName(
        masks.where("doc_id is null").selectExpr("part", "mask", "cast(null as int) as good", "cast(null as int) as bad"))
    counts = flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, kind = _kinds()
        orders, number, which = (list(x) for x in zip(*steps))
        which = np.array(which)
        for batch in batches:
            for name, row in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                n, good, bad = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in row:
                    n[c["mask"]], good[c["mask"]], bad[c["mask"]] = c["n"], c["good"], c["bad"]
                removed = kind["removed"] @ n
                total = np.bincount(which, minlength=len(FILTERS))  # steps of a filter
                shapley = np.array([removed[which == f].sum() for f in range(len(total))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(steps), pa.string()), pa.array(orders, pa.string()), pa.array(number, pa.int32()),
                     *(pa.array(x.astype(np.int64)) for x in (
                         kind["kept"] @ n, removed, kind["redundant"] @ n, kind["alone"] @ n,
                         kind["removed"] @ good, kind["removed"] @ bad, shapley[which]))],
                    [f.split()[0] for f in RESULT.split(", ")])

    return cells.mapInArrow(run, RESULT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Interactions of the five filters on all ``documents``, by source."""
    return filter_interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: The same by a window over all texts and a join of masks with all orders.
OP13_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
     w as (select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d),
     l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
           from labels group by doc_id),
     m as (select doc_id, min(doc_id) over (partition by t) as low, part,
                  case when len(words) < 50 then 1 else 0 end
                  + case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end
                  + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end
                  + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end as four from w),
     c as (select part, four + case when low < m.doc_id then 16 else 0 end as mask, count(*) as n,
                  coalesce(sum(good), 0) as good, coalesce(sum(bad), 0) as bad
           from m left join l on m.doc_id = l.doc_id group by all),
     f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(letter, bit)),
     o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
                  [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
           from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31
             and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
     s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
           from o, unnest([1, 2, 3, 4, 5]) as u(step)),
     r as (select part, filter_order, step, bit,
                  sum(case when mask & (earlier | bit) = 0 then n else 0 end)::bigint as kept,
                  sum(case when mask & bit > 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
                  sum(case when mask & bit > 0 and mask & earlier > 0 then n else 0 end)::bigint as redundant,
                  sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
                  sum(case when mask & bit > 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
                  sum(case when mask & bit > 0 and mask & earlier = 0 then bad else 0 end)::bigint as toxic_lost
           from c, s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from r
"""
