"""Stage tables on disk: read, write, shards, JSON columns, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Save a stage table (parquet).  The write is a job of its own; a
    table written to shared storage also cuts lineage for the next stage."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_shards(df: DataFrame, path: str, n: int, key: str) -> None:
    """Write ``n`` shards by hash of ``key``, as folders ``shard=<i>``, in one
    job.  Rows of a shard come from many tasks, so a hot key makes no task larger."""
    tagged = df.withColumn("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(n)))
    tagged.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards as one table (schemas merged by name)."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("shard")


def concat_shards(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def shard_split(df: DataFrame, n: int, i: int, key: str | None = None,
                by: str = "hash") -> DataFrame:
    """Shard ``i`` of ``n``: by hash of ``key`` (default), or by
    ``pmod(key, n)`` for integer ids.  For plain parallelism prefer
    partitions (``repartition``) over shards."""
    k = F.col(key)
    h = F.pmod(k, F.lit(n)) if by == "pmod" else F.pmod(F.xxhash64(k), F.lit(n))
    return df.filter(h == i)


def to_json_column(c) -> Column:
    return F.to_json(c if isinstance(c, Column) else F.col(c))


def from_json_column(c, schema: DataType | str) -> Column:
    return F.from_json(c if isinstance(c, Column) else F.col(c), schema)


def incremental_manifest(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose target is not in the manifest yet (``left_anti``)."""
    return work.join(manifest.select(*keys).distinct(), keys, "left_anti")
