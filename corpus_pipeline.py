"""The corpus pipeline: quality rules, near copies, repeated passages, personal
data, packing; each stage works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemine.llm.common import read, written
from tablemine.llm.ngram_join import similar_groups
from tablemine.llm.packing import pack, token_pieces
from tablemine.llm.pii import find_personal_data
from tablemine.llm.quality import keep_good
from tablemine.llm.recompress import remove_repeats


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """``columns`` of ``docs`` with another text and its length."""
    new = docs.withColumn("text", text)
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id; of
    rows with one id, one.  Rows without an id belong to no group and stay."""
    first = similar_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    named = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col("_first"), "left_semi")
    # ids are unique in a corpus: a window holds a row, or the rows of one id
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    named = named.withColumn("_number", number).where("_number = 1").select(*docs.columns)
    return named.union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document that loses
    none keeps its text as it is."""
    cut = remove_repeats(docs)
    return _with_text(cut, docs.columns, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _with_text(find_personal_data(docs, redact=True), docs.columns, F.col("redacted"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, in sequences of at most 2048 tokens."""
    return pack(token_pieces(docs))


STAGES = [("quality rules", quality), ("near copies", near_copies), ("repeated passages", repeated_passages),
          ("personal data", personal_data), ("packing", packing)]

#: Several stages (fitted references, a trained labeller, token packing) have
#: no SQL form; tests/llm holds the whole run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; each result is written to
    the shared checkpoint folder and read back before the next stage."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
