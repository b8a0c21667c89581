"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest pieces that still fit; then its
smallest piece is replaced with two unpacked ones if some two fill the
expanded gap more tightly.  Only lengths matter for this, and there are at
most ``capacity`` of them: the driver plans on the counts by length.  A bin's
content recurs as long as its lengths last, so the plan is a list of patterns
with how often each is used, and each pattern uses up some length: at most
``capacity`` patterns for any number of documents.  Executors number the
pieces of each length (a frequent length in many buckets) and look up bin and
place by that number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder, vocabulary_path
from .common import checkpointed, extended, parts_for, ranked, read, slices

CAPACITY = 2_048
END_ID = 0
#: Pieces that one task numbers.
BUCKET_PIECES = 50_000


def token_pieces(docs: DataFrame, id_column: str = "doc_id", column: str = "text",
                 capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and one end
    id; longer ones in pieces of ``capacity``.  Null text: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary))
        end = np.array([END_ID], "<u4")
        for part in slices(batches, column):
            ids, starts = enc.encode(part.column(column))
            row, piece, begin, length, crc = [], [], [], [], []
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                own = np.concatenate([ids[a:b].astype("<u4"), end])
                raw = own.tobytes()
                for p, s in enumerate(range(0, len(own), capacity)):
                    row.append(k)
                    piece.append(p)
                    begin.append(s)
                    length.append(min(capacity, len(own) - s))
                    crc.append(zlib.crc32(raw[4 * s:4 * (s + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_column).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long").alias(id_column), column).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many bins, [(length, how many in a bin)]) that use up
    ``counts`` (pieces by length)."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        bin_: dict[int, int] = {}
        gap, top = capacity, len(lengths)
        while gap and top:
            top = int(np.searchsorted(lengths[:top], gap, "right"))
            if not top:
                break
            n = int(lengths[top - 1])
            bin_[n] = int(min(left[n], gap // n))
            gap -= n * bin_[n]
            top -= 1
        if gap:
            small = min(bin_)
            room = gap + small
            bin_[small] -= 1
            free = left[lengths] - np.array([bin_.get(int(n), 0) for n in lengths])
            some = lengths[free > 0]
            second = np.searchsorted(some, room - some, "right") - 1
            fits = second >= 0
            # two of one length need two of it
            twice = np.zeros(capacity + 1, bool)
            twice[lengths] = free > 1
            same = fits & (second >= 0) & (some[np.maximum(second, 0)] == some) & ~twice[some]
            second = np.where(same, second - 1, second)
            fits &= second >= 0
            total = np.where(fits, some + some[np.maximum(second, 0)], 0)
            best = int(total.argmax()) if len(total) else 0
            if len(total) and total[best] > small:
                for n in (int(some[best]), int(some[second[best]])):
                    bin_[n] = bin_.get(n, 0) + 1
            else:
                bin_[small] += 1
        bin_ = {n: k for n, k in bin_.items() if k}
        times = min(int(left[n]) // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
        plan.append((times, sorted(bin_.items(), reverse=True)))
        lengths = lengths[left[lengths] > 0]
    return plan


def _lookup(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, first bin, pieces a bin, place in the bin),
    sorted: for the pieces of a length from that number on."""
    rows, used, first_bin = [], {}, 0
    for times, content in plan:
        place = 0
        for n, k in content:
            rows.append((n, used.get(n, 0), first_bin, k, place))
            used[n] = used.get(n, 0) + k * times
            place += n * k
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece``,
    ``ids_crc32`` and ``length`` (1 to ``capacity``).  Rows that tie are
    interchangeable; an empty table gives no rows."""
    pieces = checkpointed(pieces.drop("sequence_id", "offset", "_rank"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lookup = _lookup(best_two_fit(counts, capacity))
    # ranks run far below 2**50, so one sorted key holds length and rank
    held = pieces.sparkSession.sparkContext.broadcast((lookup[:, 0] * 2**50 + lookup[:, 1], lookup[:, 1:]))
    numbered = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
                      F.xxhash64("doc_id", "piece", "ids_crc32"),
                      parts_for(sum(counts.values()), BUCKET_PIECES), "_rank")
    schema = extended(pieces, sequence_id="long", offset="long")
    keep = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = held.value
        for part in batches:
            rank = part.column("_rank").to_numpy()
            length = part.column("length").to_numpy()
            at = np.searchsorted(key, length * 2**50 + rank, "right") - 1
            first, bin_, each, offset = rows[at].T if len(at) else np.empty((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(bin_ + (rank - first) // np.maximum(each, 1)),
                 pa.array(offset + (rank - first) % np.maximum(each, 1) * length)],
                [*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack(token_pieces(read(spark, sf_dir, "documents")))
