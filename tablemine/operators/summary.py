"""Corpus-level counts (aggregation operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_algorithm(papers: DataFrame, algos_col: str = "algorithms") -> DataFrame:
    """Papers per detected algorithm, plus a ``Total`` row of papers with
    any algorithm, in one pass: a paper counts for each of its algorithms and
    once for ``Total``.  Only (algorithm, count) pairs cross the shuffle."""
    kinds = F.explode(F.concat(F.col(algos_col), F.array(F.lit("Total"))))
    each = papers.filter(F.size(algos_col) > 0).select(kinds.alias("algorithm"), F.lit(1).alias("n"))
    none = papers.sparkSession.range(1).select(F.lit("Total").alias("algorithm"), F.lit(0).alias("n"))
    return each.unionByName(none).groupBy("algorithm").agg(F.sum("n").alias("n_papers"))


def corpus_summary(papers: DataFrame, hits_col: str) -> DataFrame:
    """Papers in, papers kept (at least one hit), total hits (tables, …)."""
    return papers.agg(F.count(F.lit(1)).alias("papers_in"),
                      F.count_if(F.size(hits_col) > 0).alias("papers_kept"),
                      F.coalesce(F.sum(F.size(hits_col)), F.lit(0)).cast("bigint").alias("algorithm_hits"))


def distinct_count(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    return df.agg(F.count_distinct(*cols).alias(name))


def failure_counts(df: DataFrame, answer_col: str, failed: str = "<FAILED>") -> DataFrame:
    """failed m of n at row grain."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_if(F.contains(F.col(answer_col), F.lit(failed))).alias("n_failed"))


def distinct_papers(df: DataFrame, paper_col: str = "paper_id") -> DataFrame:
    """Unique paper count (e.g. after the table filter)."""
    return df.agg(F.count_distinct(paper_col).alias("n_papers"))


def name_counts(before: DataFrame, after: DataFrame, before_col: str = "dataset",
                after_col: str = "dataset_name") -> DataFrame:
    """Unique names before and after canonicalisation."""
    b = before.agg(F.count_distinct(before_col).alias("n_names_before"))
    a = after.agg(F.count_distinct(after_col).alias("n_names_after"))
    return b.crossJoin(a)  # two one-row aggregates


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).dropDuplicates()
