"""N-gram Jaccard join over count vectors held in an R-tree.

A document is the set of its distinct word shingles.  Shingles are hashed into
groups; a document's counts by group are a point, and for two points the sum
of the smaller coordinates bounds the sets' overlap from above.  An R-tree
over the points (leaves of similar documents under their bounding boxes)
finds, for each document, the few whose bound allows the wanted similarity;
those are verified on the sets.

The tree is built cell by cell.  Documents meet in a cell if they share one of
``BANDS`` keys, each made of ``ROWS`` min-hashes; a pair at the threshold
shares none with probability (1 - 0.75**ROWS)**BANDS = 4e-12, below that of
any 64-bit hash collision here.  All documents with equal sets are one point.
Of the documents under a key, the one with the most companions leads; the cell
is all that follow a leader, so two documents under one key share a cell.  In
a cell a verified link makes two groups one, and pairs inside a group need no
check, so a cell of n copies costs n verifications and sends n - 1 links.
Cells above ``CELL_DOCS`` are cut into blocks by size of set; documents that
their block did not link to the leader's group are then held against the
blocks of near sizes, two blocks to a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, mix, read, slices, window_hashes

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
ROWS, BANDS = 3, 48
#: Coordinates of a point, documents of a leaf, documents of a cell's block.
GROUPS, LEAF, CELL_DOCS = 64, 32, 1_024

_RNG = np.random.Generator(np.random.PCG64(71))
_TIMES = _RNG.integers(0, 2**32, ROWS * BANDS, np.uint32, endpoint=False) | np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, ROWS * BANDS, np.uint32, endpoint=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, sorted) of each text, in one array,
    and where each text's begin, with the total at the end.  A text of fewer
    words has its whole word sequence as its one shingle; A-Z count as a-z."""
    text = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[off[0]:off[-1]]] if raw is not None else np.empty(0, np.uint8)
    lower = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(text), [None, pa.py_buffer((off - off[0]).astype(np.int64)), pa.py_buffer(data)])
    words = Words(lower)
    starts, size = words.starts, np.diff(words.starts)
    h = window_hashes(words.ids, width)
    inside = np.zeros(len(words.ids) + 1, np.int32)
    long_ = size >= width
    np.add.at(inside, starts[:-1][long_], 1)
    np.add.at(inside, starts[1:][long_] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    doc = np.searchsorted(starts, at, "right") - 1
    h = h[at]
    few = np.flatnonzero((size > 0) & (size < width))
    if len(few):
        whole = np.array([xxhash.xxh3_64_intdigest(words.ids[starts[k]:starts[k + 1]].tobytes(), int(size[k]))
                          for k in few.tolist()], np.uint64)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def band_keys(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each set that is not empty."""
    full = np.flatnonzero(np.diff(starts))
    at = starts[:-1][full]
    x = (mix(sets) >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat(x * _TIMES[k] + _PLUS[k], at)
            key = mix(key + low)
        keys[:, b] = key
    return keys


def profiles(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """For each row: its id, size of its set, the set's 128-bit hash and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            sets, starts = shingle_sets(part.column(column))
            n = part.num_rows
            size = np.diff(starts)
            full = size > 0
            keys = band_keys(sets, starts).view(np.int64).reshape(-1)
            raw = sets.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[8 * a:8 * b]) if b > a else None
                      for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_column), pa.array(size.astype(np.int64)), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                ["id", "size", "digest", "keys"])

    return docs.select(F.col(id_column).cast("long").alias(id_column), column).mapInArrow(run, "id long, size long, digest binary, keys array<long>")


def sets_of(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """(point long, items binary): the sorted shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            sets, starts = shingle_sets(part.column(column))
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(id_column), pa.array([raw[8 * a:8 * b] for a, b in zip(
                    starts[:-1].tolist(), starts[1:].tolist())], pa.binary())], ["point", "items"])

    return docs.select(F.col(id_column).cast("long").alias(id_column), column).mapInArrow(run, "point long, items binary")


class CountTree:
    """R-tree of count vectors: leaves of points that follow each other in
    size and then in their largest coordinates, with boxes (smallest and
    largest counts) in two levels."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.points = np.zeros((len(sets), GROUPS), np.int32)
        for k, s in enumerate(sets):
            self.points[k] = np.bincount((mix(s) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
        step = np.floor(np.log(np.maximum(self.size, 1)) * 8)
        self.order = np.lexsort((self.points[:, 1], self.points[:, 0], step))
        self.leaves = self._boxes(self.points[self.order], self.size[self.order], LEAF)
        self.nodes = self._boxes(*self.leaves, LEAF)

    @staticmethod
    def _boxes(high: np.ndarray, small: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest coordinates and smallest size under each box."""
        at = np.arange(0, len(high), each)
        return np.maximum.reduceat(high, at, 0), np.minimum.reduceat(small, at)

    @staticmethod
    def _allowed(point: np.ndarray, size: int, high: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Whether the summed smaller coordinates allow the wanted overlap:
        overlap / union >= t, union = sizes - overlap."""
        bound = np.minimum(high, point).sum(1, dtype=np.int64)
        return bound * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (size + small)

    def near(self, k: int) -> np.ndarray:
        """Points whose bound allows a link with point ``k``."""
        p, n = self.points[k], int(self.size[k])
        nodes = np.flatnonzero(self._allowed(p, n, *self.nodes))
        leaves = (nodes[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        leaves = leaves[leaves < len(self.leaves[1])]
        leaves = leaves[self._allowed(p, n, self.leaves[0][leaves], self.leaves[1][leaves])]
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        rows = self.order[rows[rows < len(self.order)]]
        return rows[self._allowed(p, n, self.points[rows], self.size[rows])]

    def linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def links_of(table: pa.Table) -> pa.Table:
    """Links that connect the linked points of a block: each point searches
    the tree; found points of other groups are verified.  If there are rows
    that ask (``asks``), only pairs with one of them count, and of two blocks
    only pairs across."""
    block = table.column("block").to_numpy()
    across = block.min() != block.max()
    ids = table.column("point").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    group = table.column("label").to_numpy().copy()
    tree = CountTree([np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()])
    first = np.flatnonzero(asks) if asks.any() else np.lexsort((ids, ids != table.column("lead").to_numpy()))
    out = []
    for k in first.tolist():
        found = tree.near(k)
        if across:
            found = found[block[found] != block[k]]
        while True:
            found = found[group[found] != group[k]]
            if not len(found):
                break
            j, found = int(found[0]), found[1:]
            if tree.linked(k, j):
                out.append((int(ids[k]), int(ids[j])))
                group[group == group[j]] = group[k]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(point, label): the smallest point reachable, for all points with a
    link.  Rounds of taking the neighbours' smallest label and then the
    label's own; each round is checkpointed, the driver sees one count."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select(F.col("a").alias("point"), F.least("m", "a").alias("label")))
    while True:
        near = (both.join(labels, both.b == labels.point).groupBy("a").agg(F.min("label").alias("m")))
        own = labels.join(near, labels.point == near.a).select(
            "point", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("point").alias("p2"), F.col("label").alias("l2"))
        now = checkpointed(own.join(up, own.label == up.p2)
                           .select("point", "old", F.least("label", "l2").alias("label")))
        changed = now.where("old <> label").limit(1).count()
        labels = now.select("point", "label")
        if not changed:
            return labels


def similar_groups(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per input row: its id, the size of its set (``n_shingles``) and
    ``component_id``, the smallest id reachable over links (its own included).

    Two documents link when 100 times the intersection of their shingle sets
    is at least 75 times their union.  Null, empty and blank texts have an
    empty set and link with nothing; equal sets always link; rows with the
    same id each give a row, and links of any of them hold for the id; a row
    without an id takes part in no link.  Other columns are ignored.
    """
    base = checkpointed(profiles(docs, id_column, column))
    full = base.where("digest is not null and id is not null")
    classes = checkpointed(full.groupBy("digest").agg(F.min("id").alias("point")))
    # (digest, id) deals a large class of equal sets over many tasks
    keyed = (full.join(classes, (full.digest == classes.digest) & (full.id == classes.point), "left_semi")
             .select(F.col("id").alias("point"), F.explode("keys").alias("key")).distinct())
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(keyed.join(shared, "key"))
    weight = members.groupBy("point").agg(F.sum("n").alias("w"))
    leads = (members.join(weight, "point").groupBy("key")
             .agg(F.max(F.struct("w", (-F.col("point")).alias("p"))).alias("m"))
             .select("key", (-F.col("m.p")).alias("lead")))
    cells = checkpointed(members.join(leads, "key").select("lead", "point").distinct())
    need = cells.select("point").distinct()
    texts = docs.join(need, docs[id_column] == need.point, "left_semi")
    sets = checkpointed(sets_of(texts, id_column, column).where("octet_length(items) > 0")
                        .dropDuplicates(["point", "items"]))
    links = cell_links(cells, sets)
    # both sides are dealt anew by digest, so a large class is split when the join runs
    twins = full.select("id", "digest").join(classes, "digest").select(F.col("id").alias("a"), F.col("point").alias("b"))
    # an id whose rows have several sets joins them; for all others the class is enough
    labels = components(links.union(twins.where("a <> b")))
    found = base.join(labels, base.id == labels.point, "left")
    return found.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"),
                        F.coalesce("label", "id").alias("component_id"))


def cell_links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked points of each cell."""
    # cells are cut into blocks on slim rows; the sets join once the blocks are known
    sets = sets.withColumn("tag", F.xxhash64("items"))
    slim = cells.join(sets.select("point", "tag", F.octet_length("items").alias("bytes")), "point").withColumn(
        "band", F.floor(F.log(F.col("bytes") / 8) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")).drop("bytes")
    sizes = slim.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = slim.join(sizes, "lead").withColumn(
        "block", F.when(F.col("n") <= CELL_DOCS, F.lit(-1).cast("long")).otherwise(
            F.col("band") * 1_000_000 + F.pmod(F.xxhash64("point"), F.ceil(F.col("n") / CELL_DOCS)) % 1_000_000))
    rows = checkpointed(rows.select("lead", "block", "band", "point", "tag"))
    with_sets = lambda x: x.join(sets, ["point", "tag"])
    large = rows.where("block >= 0")
    blocks = large.select("lead", "block").distinct()
    hubs = blocks.join(large.where("lead = point").select("lead", "point", "tag"), "lead")
    one = rows.select("lead", "block", "point", "tag").union(hubs.select("lead", "block", "point", "tag")).distinct()
    first = checkpointed(
        with_sets(one).select("lead", "block", "point", "items", F.col("point").alias("label"), F.lit(False).alias("asks"))
        .groupBy("lead", "block").applyInArrow(links_of, "a long, b long"))
    if not large.limit(1).count():
        return first
    # blocks of large cells: what is not in the leader's group asks the other blocks of near sizes
    label = components(first)
    known = (large.join(label.withColumnRenamed("label", "l"), "point", "left")
             .withColumn("label", F.coalesce("l", "point")).drop("l"))
    heart = known.where("lead = point").select("lead", F.col("label").alias("core")).dropDuplicates(["lead"])
    known = known.join(heart, "lead").withColumn("asks", F.col("label") != F.col("core"))
    near = known.groupBy("lead", "block", "band").agg(F.max("asks").alias("any"))
    # both ways: rows go to a pair of blocks if they ask or the other block does
    pairs = near.join(near.select("lead", F.col("block").alias("other"), F.col("band").alias("band2"),
                                  F.col("any").alias("asked")), "lead").where(
        "block <> other and abs(band - band2) <= 1 and (any or asked)").select("lead", "block", "other", "asked")
    sent = known.join(pairs, ["lead", "block"]).where("asks or asked").select(
        "lead", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "point", "tag", "label", "asks")
    second = with_sets(sent).groupBy("lead", "low", "high").applyInArrow(links_of, "a long, b long")
    return first.union(checkpointed(second))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a shingle similarity of 0.75 or more."""
    return similar_groups(read(spark, sf_dir, "documents"))


#: The same by joining every document with every other over shared shingles.
OP3_SQL = r"""
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then []
          when len(words) < 5 then [array_to_string(words, ' ')]
          else list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r(doc_id, label) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.label),
c as (select doc_id, min(label) as label from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.label, w.doc_id) as component_id
from w left join n using (doc_id) left join c using (doc_id)
"""
