"""Streaming ingestion with keyed state: which items were seen before stands in
the state store, a key where its rows arrive, so a micro-batch looks up its own
keys only and never reads a manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class _FirstSeen(StatefulProcessor):
    """Hands on the rows of a key's first micro-batch, and no later ones."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if any(part is None for part in key):
            yield from rows
        elif not self.seen.exists():
            yield from rows
            self.seen.update((True,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if all(part is not None for part in key):
            self.seen.update((True,))


def new_items(stream: DataFrame, keys: list[str], done: DataFrame | None = None,
              ttl: timedelta | None = None) -> DataFrame:
    """The streaming twin of ``incremental_manifest``: rows of ``stream`` whose
    key came in no earlier micro-batch and is not in ``done``.

    All rows of a key that come in the key's first micro-batch stay, as in the
    batch form; so do rows with a NULL in a key, which equal no key.  ``done``
    (a batch DataFrame) fills the state in the first micro-batch and is not read
    again.  With ``ttl`` a key is forgotten that long after it was first seen,
    which bounds the state; without it the state keeps every key, once.

    Needs the RocksDB state store (``keyed_state`` sets it for the queries
    started within).
    """
    state = None if done is None else done.select(*keys).dropna().distinct().groupBy(*keys)
    ttl_ms = None if ttl is None else max(1, int(ttl / timedelta(milliseconds=1)))
    return stream.groupBy(*keys).transformWithState(
        _FirstSeen(ttl_ms), stream.schema, "Append", "None" if ttl is None else "ProcessingTime", state)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within use the RocksDB state store, whose changes go to
    the query's checkpoint folder, and no micro-batches without rows (a time to
    live asks for one after the other, so ``availableNow`` would never end);
    the session's own settings come back after."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def process_new_items_keyed(stream: DataFrame, keys: list[str], transform: Callable[[DataFrame], DataFrame],
                            output_path: str, checkpoint_location: str, done: DataFrame | None = None,
                            ttl: timedelta | None = None, trigger_once: bool = True) -> StreamingQuery:
    """``process_new_items`` without a manifest: new items go through
    ``transform`` (row-local, it sees a streaming DataFrame) into a Parquet
    table.  State and the list of written files share the checkpoint, so a
    retried or restarted micro-batch leaves every row there once.  ``done`` is
    used by the first start only."""
    with keyed_state(stream.sparkSession):
        w = (transform(new_items(stream, keys, done, ttl)).writeStream.format("parquet").outputMode("append")
             .option("path", output_path).option("checkpointLocation", checkpoint_location))
        if trigger_once:
            w = w.trigger(availableNow=True)
        return w.start()
