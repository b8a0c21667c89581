"""Removal of repeated passages by recompression.

Every document is a sequence of word names (hashes).  Rounds rename it: first
runs of one word become one symbol each, then, round by round, a symbol whose
name falls on the left side joins a following one whose name falls on the
right side.  A name follows from the content alone, so all tasks name alike
and equal passages get equal symbols inside; only symbols near their ends can
differ.  For each symbol the words that decided it (its context) are kept, so
it is known which windows force a symbol upon every other occurrence.

One exchange counts the high-level symbols.  A window of ``width`` words that
forces a symbol that occurs only once cannot occur twice; this clears almost
all text.  The remaining windows are verified in a second exchange by 128-bit
hashes of their words, and the words under repeated windows go.

Tasks exchange symbols as sorted arrays, one per (chunk of documents, bucket
of names), each name once with a mark if the chunk holds it more often.  So a
passage that many documents share weighs one entry a chunk, and a bucket's
size does not depend on how often its names occur.

Marks come back by place in the chunk, so a chunk's rows are put in an order
of their own (row hash, then text) whenever they are read: Spark promises none.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, mix, parts_for, read

WIDTH = 35
#: Rounds of pairing; a round joins about a quarter of the symbols.
ROUNDS = 6
#: Documents and bytes of a chunk, documents and bytes for each bucket of names.
CHUNK_DOCS, CHUNK_BYTES = 1_000, 4 << 20
BUCKET_DOCS, BUCKET_BYTES, LEAST = 4_000, 16 << 20, 64

_LEFT, _RIGHT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def recompress(ids: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents after the rounds: name, and the first and the
    last (exclusive) word of the context that decides it.  A context that
    hangs on a document's edge reaches one word beyond it."""
    n = len(ids)
    doc_first = np.zeros(n + 1, bool)
    doc_first[starts] = True
    # runs of one word
    new = doc_first[:-1].copy()
    new[1:] |= ids[1:] != ids[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    size = last - first
    name = ids[first]
    name = np.where(size > 1, mix(name * _LEFT + size.astype(np.uint64)), name)
    lo, hi = first - 1, last + 1
    opens = doc_first[first]
    for k in range(rounds):
        m = len(name)
        if m < 2:
            break
        left = (mix(name + np.uint64(k + 1) * _RIGHT) >> np.uint64(63)).astype(bool)
        joint = ~opens[1:]
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:] & joint
        # an unpaired symbol was decided by the neighbour that did not fit
        alone = left & ~pair
        low, high = lo.copy(), hi.copy()
        nxt = alone[:-1] & joint
        high[:-1][nxt] = np.maximum(hi[:-1], hi[1:])[nxt]
        at_end = alone & np.append(~joint, True)
        high[at_end] += 1
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        alone = ~left & ~second
        prv = np.flatnonzero(alone[1:] & joint) + 1
        low[prv] = np.minimum(lo[prv], lo[prv - 1])
        at_start = alone & opens
        low[at_start] -= 1
        p = np.flatnonzero(pair)
        name = name.copy()
        name[p] = mix(name[p] * _LEFT + mix(name[p + 1] + _RIGHT))
        low[p], high[p] = np.minimum(lo[p], lo[p + 1]), np.maximum(hi[p], hi[p + 1])
        keep = ~second
        name, lo, hi, opens = name[keep], low[keep], high[keep], opens[keep]
    return name, lo, hi


def cleared(lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows (by first word) that hold one of the given contexts."""
    n = int(starts[-1])
    doc = np.searchsorted(starts, np.maximum(lo, 0), "right") - 1
    ok = (lo >= starts[doc]) & (hi <= starts[doc + 1]) & (hi - lo <= width)
    lo, hi, doc = lo[ok], hi[ok], doc[ok]
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(hi - width, starts[doc]), 1)
    np.add.at(step, lo + 1, -1)
    return np.cumsum(step[:-1]) > 0


def whole_windows(starts: np.ndarray, width: int) -> np.ndarray:
    """Words at which a window of one document begins."""
    n = int(starts[-1])
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(starts)
    fits = size >= width
    np.add.at(ok, starts[:-1][fits], 1)
    np.add.at(ok, starts[1:][fits] - width + 1, -1)
    return np.cumsum(ok[:-1]) > 0


def covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words under the windows that begin at ``at``."""
    step = np.zeros(n + 1, np.int32)
    step[at] += 1
    step[at + width] -= 1
    return np.cumsum(step[:-1]) > 0


def windows_of(ids: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of each window, doubled up from shorter ones."""
    c = np.uint64(multiplier)
    block, size, power = ids, 1, c
    out, done = None, 0
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = block, size
                else:
                    m = len(ids) - done - size + 1
                    out = block[:max(m, 0)] * _power(c, done) + out[size:size + max(m, 0)]
                    done += size
            left >>= 1
            if left:
                m = len(block) - size
                block = block[:max(m, 0)] * power + block[size:size + max(m, 0)]
                size *= 2
                power = power * power
    return mix(out)


def _power(c: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(c), n, 1 << 64))


# -- exchange of names ----------------------------------------------------

NAMES = "chunk int, bucket int, names binary, marks binary"


def names_by_bucket(keys: np.ndarray, check: np.ndarray | None, buckets: int, count: np.ndarray | None = None):
    """Distinct names by (bucket, name): order of first places, its inverse,
    bucket edges, and which names occur more than once.  ``check``: more bits
    of the name; ``count``: how often each place counts (once)."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort(([check] if check is not None else []) + [keys, bucket])
    k, b = keys[order], bucket[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    rank = np.cumsum(new) - 1
    code = np.empty(len(k), np.int64)
    code[order] = rank
    first = order[new]
    often = np.bincount(code, count, minlength=len(first)) > 1
    edges = np.searchsorted(bucket[first], np.arange(buckets + 1))
    return first, code, edges, often


def names_table(chunk: int, keys: np.ndarray, check: np.ndarray | None, buckets: int,
                count: np.ndarray | None = None) -> list[tuple]:
    first, _, edges, often = names_by_bucket(keys, check, buckets, count)
    keys = keys[first]
    check = check[first] if check is not None else None
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        blob = keys[part].tobytes() + (check[part].tobytes() if check is not None else b"")
        rows.append((chunk, b, blob, np.packbits(often[part]).tobytes()))
    return rows


def as_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table({"chunk": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()),
                     "names": pa.array(cols[2], pa.binary()), "marks": pa.array(cols[3], pa.binary())})


def mark_repeats(width: int):
    """For a bucket's arrays: mark each name that its chunk holds twice or
    another chunk holds too.  ``width``: bytes of a name."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        buckets = table.column("bucket").to_pylist()
        names = table.column("names").to_pylist()
        marks = table.column("marks").to_pylist()
        if buckets[0] < 0:  # what a chunk tells itself
            return as_table(list(zip(chunks, buckets, names, marks)))
        size = [len(x) // width for x in names]
        key = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(names, size)])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if width == 16 and same.any():
            check = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(names, size)])
            if (same & (check[order][1:] != check[order][:-1])).any():
                order = np.lexsort((check, key))
            same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
        found = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks, size)]
                               ).astype(bool)
        hit = np.zeros(len(key), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        found |= hit
        ends = np.cumsum([0, *size])
        return as_table([(c, b, b"", np.packbits(found[i:j]).tobytes())
                         for c, b, i, j in zip(chunks, buckets, ends[:-1].tolist(), ends[1:].tolist())])

    return run


def marked(code: np.ndarray, edges: np.ndarray, bits: pa.Table) -> np.ndarray:
    """Whether each name is marked, in the order of ``code``."""
    flags = np.zeros(int(edges[-1]), bool)
    for b, m in zip(bits.column("bucket").to_pylist(), bits.column("marks").to_pylist()):
        if b >= 0:
            n = int(edges[b + 1] - edges[b])
            flags[edges[b]:edges[b + 1]] = np.unpackbits(np.frombuffer(m, np.uint8), count=n)
    return flags[code] if len(code) else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, column: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Remove every word under a window of ``width`` words whose sequence
    starts anywhere else in the table.

    Adds ``kept`` (the words left, one space apart), ``n_words`` and
    ``n_removed`` (columns of these names, or named ``chunk``, are replaced).
    Windows are judged on the input.  Null, empty and shorter texts lose
    nothing (null: kept is empty); repeated rows lose all that a window covers
    (where one row stands more than ``CHUNK_DOCS`` times, equal rows travel as
    one with a count); an empty table gives no rows.
    """
    docs = docs.drop("kept", "n_words", "n_removed", "chunk", _ROW, _COPIES)
    per_row = docs.select(F.xxhash64(*docs.columns).alias("h"), F.octet_length(column).cast("long").alias("b"))
    sizes = per_row.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).agg(
        F.sum("n"), F.sum("b"), F.max("n")).first()
    rows, size, copies = (int(x or 0) for x in sizes)
    if copies > CHUNK_DOCS:
        once = docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(_COPIES))
        cut = _remove(once, column, width, rounds, rows, size).withColumn(
            _COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_COPIES))))
        return cut.drop(_COPIES)
    return _remove(docs.withColumn(_COPIES, F.lit(1).cast("long")), column, width, rounds, rows, size).drop(_COPIES)


_ROW, _COPIES = "_row_hash", "_row_copies"


def in_order(table: pa.Table, column: str) -> pa.Table:
    """A chunk's rows by hash and text, whatever order they came in; rows
    equal in both have the same words, so their order makes no difference."""
    if table.num_rows < 2:
        return table
    keys = pa.table({"h": table.column(_ROW), "t": pc.fill_null(table.column(column), "")})
    return table.take(pc.sort_indices(keys, sort_keys=[("h", "ascending"), ("t", "ascending")]))


def _remove(docs: DataFrame, column: str, width: int, rounds: int, rows: int, size: int) -> DataFrame:
    chunks = max(LEAST, parts_for(rows, CHUNK_DOCS), parts_for(size, CHUNK_BYTES))
    buckets = max(LEAST, parts_for(rows, BUCKET_DOCS), parts_for(size, BUCKET_BYTES))
    named = docs.withColumn(_ROW, F.xxhash64(*[c for c in docs.columns if c != _COPIES]))
    dealt = named.withColumn("chunk", F.pmod(F.col(_ROW), F.lit(chunks)).cast("int")).repartition("chunk")
    multipliers = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def texts(table: pa.Table) -> Words:
        return Words(table.column(column).combine_chunks())

    def copies(table: pa.Table, starts: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """How many rows the row of each word stands for."""
        n = table.column(_COPIES).to_numpy()
        return n[np.searchsorted(starts, at, "right") - 1] if (n > 1).any() else None

    def symbols(table: pa.Table) -> pa.Table:
        table = in_order(table, column)
        words = texts(table)
        if not len(words.ids):
            return as_table([])
        name, lo, hi = recompress(words.ids, words.starts, rounds)
        # the middle of a context lies in its document
        count = copies(table, words.starts, (lo + hi) // 2)
        return as_table(names_table(table.column("chunk")[0].as_py(), name, None, buckets, count))

    def hashes(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (windows_of(words.ids, width, m)[at] for m in multipliers)
        return a, b

    def windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table([])
        table = in_order(table, column)
        words = texts(table)
        fits = whole_windows(words.starts, width)
        if not fits.any():
            return as_table([])
        name, lo, hi = recompress(words.ids, words.starts, rounds)
        _, code, edges, _ = names_by_bucket(name, None, buckets)
        once = ~marked(code, edges, bits)
        at = np.flatnonzero(fits & ~cleared(lo[once], hi[once], words.starts, width))
        chunk = table.column("chunk")[0].as_py()
        if not len(at):
            return as_table([])
        open_ = np.zeros(len(fits), bool)
        open_[at] = True
        own = (chunk, -1 - chunk, b"", np.packbits(open_).tobytes())
        count = copies(table, words.starts, at)
        return as_table([own, *names_table(chunk, *hashes(words, at), buckets, count)])

    def cut(table: pa.Table, bits: pa.Table) -> pa.Table:
        table = in_order(table, column)
        words = texts(table)
        n, starts = len(words.ids), words.starts
        gone = np.zeros(n, bool)
        own = [m for b, m in zip(bits.column("bucket").to_pylist(), bits.column("marks").to_pylist()) if b < 0]
        if own:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(own[0], np.uint8), count=n))
            _, code, edges, _ = names_by_bucket(*hashes(words, at), buckets)
            gone = covered(at[marked(code, edges, bits)], n, width)
        keep = ~gone
        lost = np.concatenate([[0], np.cumsum(gone)])[starts]
        kept = []
        for k, raw in enumerate(table.column(column).cast(pa.binary()).to_pylist()):
            cut_words = (raw or b"").split()
            if lost[k + 1] > lost[k]:
                cut_words = compress(cut_words, keep[starts[k]:starts[k + 1]].tolist())
            kept.append(b" ".join(cut_words))
        out = table.drop_columns(["chunk", _ROW])
        out = out.append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))
        out = out.append_column("n_words", pa.array(np.diff(starts).astype(np.int64)))
        return out.append_column("n_removed", pa.array(np.diff(lost).astype(np.int64)))

    def cut_or_none(table: pa.Table, bits: pa.Table) -> pa.Table:
        return cut(table, bits) if table.num_rows else empty

    schema = extended(docs, kept="string", n_words="long", n_removed="long")
    from pyspark.sql.pandas.types import to_arrow_schema
    empty = to_arrow_schema(schema).empty_table()
    found = dealt.groupBy("chunk").applyInArrow(symbols, NAMES)
    bits = found.groupBy("bucket").applyInArrow(mark_repeats(8), NAMES)
    open_windows = dealt.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(windows, NAMES)
    repeats = open_windows.groupBy("bucket").applyInArrow(mark_repeats(16), NAMES)
    return dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(cut_or_none, schema)


def op4_recompression(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words, removed from ``documents``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by listing all windows.
OP4_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
     s as (select doc_id, words, unnest(generate_series(1, len(words) - 34)) as p from w where len(words) >= 35),
     h as (select doc_id, p, array_to_string(list_slice(words, p, p + 34), ' ') as seq from s),
     r as (select seq from h group by seq having count(*) > 1),
     g as (select distinct h.doc_id, unnest(generate_series(h.p, h.p + 34)) as pos from h join r using (seq)),
     gone as (select doc_id, list(pos) as poss, count(*) as n from g group by doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed,
       sha256(array_to_string(case when gone.n is null then w.words
              else list_filter(w.words, lambda x, i: not list_contains(gone.poss, i)) end, ' ')) as kept_sha256
from w left join gone using (doc_id)
"""
