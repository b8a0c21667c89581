"""Registered queries: one per operator of the inventory, each over the
driver tables (or data Spark derives from them), each with its DuckDB
oracle when one exists.

Every query reads whole tables; fixtures that need text (LaTeX, JSON,
BibTeX) render it from the tables inside the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


SMALL_TABLES = {"region", "nation"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table.  Every query here does CPU-heavy text work per row,
    so a scan with fewer partitions than cores (a single-row-group file) is
    spread round-robin first; a wide scan (any real cluster input) is left
    as it is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    if table not in SMALL_TABLES:
        from ..session import ensure_parallelism
        df = ensure_parallelism(df)
    return df


# Importing the query modules fills the registry.
from . import q_tables, q_filters, q_answers, q_entities, q_sources, q_structure  # noqa: E402,F401
