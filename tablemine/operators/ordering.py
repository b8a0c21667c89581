"""Global order with gapless ranks, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def sorted_inputs(df: DataFrame, cols: list[str], rank_col: str = "rank") -> DataFrame:
    """``df`` in the order of ``cols`` (nulls first) with ``rank_col`` from 0.

    Spark samples range bounds and sorts each range in a task of its own; the
    sorted ranges are written to the checkpoint folder, so their numbering
    cannot change when a task runs again.  A row's rank is the size of all
    ranges before its own plus its place there; only one count per range is
    brought together.  Rows equal in ``cols`` follow one another in some order;
    very many of them are one range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()  # range number above 33 bits, place in the range below
    ranges = df.orderBy(*cols).withColumn("_at", place).checkpoint()
    ranges = ranges.select("*", F.shiftright("_at", 33).cast("int").alias("_range"))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: bounded by the number of partitions
    offsets = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = ranges.join(F.broadcast(offsets), "_range")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(rank_col, F.col("_before") + low).drop("_at", "_range", "_before")
