"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

#: Bytes of text that a Python task holds as word lists at a time.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that
    later plans neither recompute it nor depend on the executors that made it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``max_bytes`` of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.random.Generator(np.random.PCG64(20_240_601)).integers(
    1, 2**64, (2, 1024), np.uint64, endpoint=False) | np.uint64(1)


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts.

    ``ids``: 64-bit hash of each word, the same in every task; ``starts``:
    where each text's words begin in it, with the total at the end; ``first``,
    ``last``: byte range of each word in ``data``; ``bounds``: of each text.
    """

    def __init__(self, column: pa.Array, second: bool = False) -> None:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.empty(0, np.uint8)
        self.data, self.bounds = data, off - off[0]
        space = _SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = space[:-1]
        inner = self.bounds[:-1][self.bounds[:-1] < len(data)]
        edge[inner] = True
        self.first = np.flatnonzero(~space & edge[:-1])
        edge[1:-1] = space[1:]
        edge[self.bounds[self.bounds > 0]] = True
        self.last = np.flatnonzero(~space & edge[1:]) + 1
        self.starts = np.searchsorted(self.first, self.bounds)
        letters = data[~space]
        size = self.last - self.first
        at = np.cumsum(size) - size
        place = np.arange(len(letters)) - np.repeat(at, size)
        np.minimum(place, 1023, out=place)
        letters = letters.astype(np.uint64) + np.uint64(1)
        self.ids = self._sums(0, letters, place, at, size)
        self.second = self._sums(1, letters, place, at, size) if second else None

    def _sums(self, k: int, letters: np.ndarray, place: np.ndarray, at: np.ndarray,
              size: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint64)
        h = np.add.reduceat(_POWERS[k][place] * letters, at)
        h = mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(size > 1000).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.word(i), k)
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.first[i]:self.last[i]].tobytes()


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(ids: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive ids, by start (``len - width + 1`` many,
    none if shorter); windows across documents are the caller's to drop."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    step = _MULT + np.uint64(2 * seed)
    for j in range(width):
        h *= step
        h += ids[j:j + n]
    return mix(h)


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further columns (name=type) at its end."""
    more = [StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in columns.items()]
    return StructType([*df.schema.fields, *more])


def parts_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def ranked(df: DataFrame, key: list[str], order: list[Column], spot: Column,
           buckets: int, out: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, without one task per key.

    ``spot`` is a 64-bit value that depends on the row alone; a key's rows are
    cut into ``buckets`` by it, numbered in each, and offset by the sizes of
    the buckets before.  Within a bucket rows follow ``order``.
    """
    cut = df.withColumn("_b", F.pmod(spot, F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # null keys number like any other
    at = Window.partitionBy(*key, "_b").orderBy(*order)
    rows = cut.withColumn("_r", F.row_number().over(at) - 1).alias("rows")
    offs = offs.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_b").alias("_b2"), "_o")
    cond = F.col("_b") == F.col("_b2")
    for k in key:
        cond = cond & F.col(f"rows.{k}").eqNullSafe(F.col(f"_k_{k}"))
    return (rows.join(offs, cond).withColumn(out, (F.col("_o") + F.col("_r")).cast("long"))
            .drop("_b", "_b2", "_r", "_o", *[f"_k_{k}" for k in key]))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back."""
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder.rstrip('/')}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
