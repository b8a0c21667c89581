"""Manifest-based incremental processing on a streaming source."""

import os
import tempfile
from datetime import timedelta

from pyspark.sql import functions as F

from tablemine.streaming.keyed import keyed_state, process_new_items_keyed
from tablemine.streaming.manifest import process_new_items


def test_process_new_items_skips_done_work(spark):
    base = tempfile.mkdtemp(prefix="tablemine-stream-")
    src, out, manifest, ckpt = (os.path.join(base, x) for x in ("src", "out", "manifest", "ckpt"))
    spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string") \
        .write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame([(i,) for i in range(0, 10, 2)], "id long").write.parquet(manifest)
    stream = spark.readStream.schema("id long, text string").parquet(os.path.join(src, "*"))
    q = process_new_items(stream, manifest, ["id"], lambda df: df.withColumn("n", F.length("text")),
                          out, ckpt)
    q.awaitTermination(120)
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == [1, 3, 5, 7, 9]
    assert sorted(r.id for r in spark.read.parquet(manifest).collect()) == list(range(10))


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(os.path.join(folder, name))


def _keyed(spark, base, done=None, ttl=None):
    stream = (spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(base, "src", "*")))
    q = process_new_items_keyed(stream, ["id"], lambda df: df.withColumn("n", F.length("text")),
                                os.path.join(base, "out"), os.path.join(base, "ckpt"), done, ttl)
    assert q.awaitTermination(100)
    assert q.exception() is None
    out = sorted((tuple(r) for r in spark.read.parquet(os.path.join(base, "out")).collect()), key=str)
    return out, q.recentProgress


def test_keyed_state_over_triggers_and_a_restart(spark):
    base = tempfile.mkdtemp(prefix="tablemine-keyed-")
    src = os.path.join(base, "src")
    big = (1 << 60) + 1
    done = spark.createDataFrame([(0,), (0,), (None,), (6,)], "id long")
    _write(spark, src, "b1", [(0, "done"), (1, "a"), (1, "bb"), (None, "x"), (big, None)])
    _write(spark, src, "b2", [(1, "late"), (2, "ccc"), (None, "x"), (big, "late")])
    _write(spark, src, "b3", [(2, "late"), (3, ""), (0, "done")])
    out, progress = _keyed(spark, base, done)
    first = sorted([(1, "a", 1), (1, "bb", 2), (2, "ccc", 3), (3, "", 0), (None, "x", 1), (None, "x", 1),
                    (big, None, None)], key=str)
    assert out == first
    assert sum(p["numInputRows"] > 0 for p in progress) == 3
    _write(spark, src, "b4", [(3, "late"), (6, "done"), (7, "new"), (big, "late")])
    out, progress = _keyed(spark, base, done)
    assert out == sorted(first + [(7, "new", 3)], key=str)
    work = [p for p in progress if p["numInputRows"]]
    # the restarted query reads the four new rows and writes one key
    assert [p["numInputRows"] for p in work] == [4]
    assert work[0]["stateOperators"][0]["numRowsUpdated"] == 1


def test_keyed_state_forgets_after_its_time(spark):
    base = tempfile.mkdtemp(prefix="tablemine-ttl-")
    src = os.path.join(base, "src")
    _write(spark, src, "b1", [(1, "a")])
    _write(spark, src, "b2", [(1, "again")])
    out, _ = _keyed(spark, base, ttl=timedelta(milliseconds=1))
    assert out == [(1, "a", 1), (1, "again", 5)]


def test_keyed_state_leaves_the_session_settings(spark):
    names = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = [spark.conf.get(name) for name in names]
    with keyed_state(spark):
        assert [spark.conf.get(name) for name in names] != before
    assert [spark.conf.get(name) for name in names] == before
