"""Streaming ingestion: the row-local operators are valid on a streaming
DataFrame; skipping already-processed work is a per-micro-batch
``left_anti`` against the manifest table, appended to afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.datasets import incremental_manifest


BATCH = "batch_id"


def process_new_items(stream: DataFrame, manifest_path: str, keys: list[str],
                      transform: Callable[[DataFrame], DataFrame], output_path: str,
                      checkpoint_location: str, trigger_once: bool = True) -> StreamingQuery:
    """For each micro-batch: drop items already in the manifest, run
    ``transform``, write the result and the new keys.

    A batch's rows go to a folder of their batch id and replace what an earlier
    attempt of the batch left there; the manifest notes the batch of each key,
    and a retried batch does not count its own keys as done.  So every row is
    there once after any retry (keys may stand in the manifest twice).
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.option("mergeSchema", "true").parquet(manifest_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            done = df.limit(0).select(*keys)
        if BATCH in done.columns:
            done = done.filter(F.col(BATCH).isNull() | (F.col(BATCH) != batch_id))
        fresh = incremental_manifest(df, done, keys).persist()
        try:
            transform(fresh).write.mode("overwrite").parquet(f"{output_path}/{BATCH}={batch_id}")
            (fresh.select(*keys, F.lit(batch_id).cast("long").alias(BATCH)).distinct()
             .write.mode("append").parquet(manifest_path))
        finally:
            fresh.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
