"""A durable store of model answers, addressed by the prompt's content.

Asking a model is by far the dearest step of the pipeline.  Answers are kept
in a folder of Parquet files as (prompt hash, answer); a run asks only prompts
whose hash is not there.  Prompts go in batches, each committed by a write of
its own: a lost job loses the batch it was at, and its rerun asks no other
prompt again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import lookup
from .model import ModelFactory, apply_model

SCHEMA = "prompt_hash string, answer string"


def prompt_hash(prompt) -> F.Column:
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_hash, answer), one row per hash; empty where nothing is stored."""
    try:
        found = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    # two runs at one time may both have answered a prompt: the least answer, for all of them
    return found.groupBy("prompt_hash").agg(F.min("answer").alias("answer"))


def apply_model_once(df: DataFrame, prompt_col: str, model_factory: ModelFactory, store: str,
                     out_col: str = "answer", batches: int = 1, max_records_per_batch: int | None = None) -> DataFrame:
    """Add ``out_col`` = the model's answer to each row's prompt, asking each
    distinct prompt at most once over all runs on one ``store`` (a shared
    folder).  ``batches``: commits of a run.  A null prompt counts as empty."""
    spark = df.sparkSession
    prompts = df.select(prompt_hash(F.col(prompt_col)).alias("prompt_hash"),
                        F.coalesce(prompt_col, F.lit("")).alias("prompt")).dropDuplicates(["prompt_hash"])
    for k in range(batches):
        own = prompts.filter(F.pmod(F.conv(F.substr("prompt_hash", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(batches)) == k)
        fresh = own.join(stored_answers(spark, store).select("prompt_hash"), "prompt_hash", "left_anti")
        answered = apply_model(fresh, "prompt", model_factory, "answer", max_records_per_batch)
        answered.select("prompt_hash", "answer").write.parquet(f"{store.rstrip('/')}/run={uuid.uuid4().hex}")
    known = stored_answers(spark, store).withColumnRenamed("answer", out_col)
    # one prompt may stand in very many rows
    return lookup(df.withColumn("prompt_hash", prompt_hash(F.col(prompt_col))), known, "prompt_hash").drop("prompt_hash")
