"""Every registered query at sf0.001 against its DuckDB oracle (row count,
columns, order-insensitive values); queries without an oracle must run."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tablemine.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _duck_type(dt):
    from pyspark.sql import types as T
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR",
             T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN"}
    for k, v in names.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return dt.simpleString().upper()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {f.name: _duck_type(f.dataType) for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert _bag(df.columns, rows) == _bag(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["l_orderkey", "n_numeric_cells", "sum_qty"]
    assert df.count() > 0
