"""Queries over rendered tables: blocks, cells, numeric cells (RT fixtures
on ``lineitem``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import extract_table_blocks, papers_with_tables
from ..operators.cells import numeric_cells, table_cells
from .queries import read, register
from .render import lineitem_papers

_KEYS = ["l_orderkey", "chunk", "paper_id", "table_index"]


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = lineitem_papers(read(spark, sf_dir, "lineitem"))
    return papers_with_tables(extract_table_blocks(papers)).drop("full_paper_latex_code")


def _numeric_per_order(spark, sf_dir, grammar):
    cells = table_cells(order_tables(spark, sf_dir), keep_cols=_KEYS)
    num = numeric_cells(cells, grammar=grammar)
    return (num.groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_numeric_cells"),
                 F.sum(F.when(F.col("col_index") == 2, F.col("value").try_cast("decimal(18,2)")))
                  .cast("decimal(18,2)").alias("sum_qty")))


_NUMERIC_ORACLE = """
SELECT l_orderkey,
       count(*) * 3 + CASE WHEN l_orderkey % 8 = 7 THEN {extra} ELSE 0 END AS n_numeric_cells,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_qty
FROM lineitem GROUP BY l_orderkey
"""


@register("numeric_cells", _NUMERIC_ORACLE.format(extra=2))
def q_numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lineitem → LaTeX → blocks → cells → lenient numeric cells
    → per-order count and quantity sum."""
    return _numeric_per_order(spark, sf_dir, "lenient")


@register("numeric_cells_strict", _NUMERIC_ORACLE.format(extra=1))
def q_numeric_cells_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric_per_order(spark, sf_dir, "strict")


@register("extract_table_blocks", """
SELECT l_orderkey, count(DISTINCT l_orderkey) AS n_tables,
       CAST(count(*) AS BIGINT) AS n_items
FROM lineitem GROUP BY l_orderkey
""")
def q_extract_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per rendered table survives (figure-wrapped copies are
    dropped as contained, unbalanced ones repaired); the line items are
    counted back from the block text."""
    t = order_tables(spark, sf_dir)
    items = F.regexp_count(F.col("table_source"), F.lit(r"\n\d+ & \d+ & "))
    return (t.groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_tables"), F.sum(items).cast("bigint").alias("n_items")))


@register("table_cells", """
SELECT l_orderkey,
       count(*) + 1 + CASE WHEN l_orderkey % 8 = 4 THEN 1 WHEN l_orderkey % 8 = 7 THEN 1 ELSE 0 END
         AS n_rows,
       3 * count(*) + 3 + CASE WHEN l_orderkey % 8 = 4 THEN 1 WHEN l_orderkey % 8 = 7 THEN 3 ELSE 0 END
         AS n_cells,
       CAST(sum(l_partkey) AS BIGINT) AS sum_partkey
FROM lineitem GROUP BY l_orderkey
""")
def q_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table_cells(order_tables(spark, sf_dir), keep_cols=_KEYS)
    first_col_int = F.when((F.col("col_index") == 0) & F.col("cell").rlike(r"^\d+$"),
                           F.col("cell").cast("bigint"))
    return (cells.groupBy("l_orderkey")
            .agg(F.count_distinct("paper_id", "table_index", "tabular_index", "row_index")
                  .alias("n_rows"),
                 F.count(F.lit(1)).alias("n_cells"),
                 F.sum(first_col_int).cast("bigint").alias("sum_partkey")))


@register("papers_with_tables", """
SELECT DISTINCT l_orderkey, 0 AS table_index FROM lineitem
""")
def q_papers_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, table ordinal) rows; papers without tables vanish."""
    return order_tables(spark, sf_dir).select("l_orderkey", "table_index")
