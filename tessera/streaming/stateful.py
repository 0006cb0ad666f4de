"""Leases and idempotent intake as keyed state machines over a stream, and a sink that commits each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.leads import EVENT, RETRIES, TOLD, told
from tessera.sources.io import exists

#: Seconds of event time after its reservation for which a key is remembered; past the retries nothing can change but that it is forgotten.
KEEP = 2 * RETRIES


class Leases(StatefulProcessor):
    """The lease machine of one key: what was reserved and how it is announced, kept apart from what its claims do.

    The first reservation is stored once and never changed. Two timers follow it: past the retries a key without a claim is
    left to people, and after ``KEEP`` seconds it is forgotten. A key's events of one micro-batch are judged by (at, event_id);
    the source's limit on files or bytes of a micro-batch bounds them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reserved = handle.getValueState("reserved", "payload string, born long, mode string")
        self.claim = handle.getValueState("claim", "status string, changed long, holder long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N803
        state = None
        if self.reserved.exists():
            (payload, born, mode), (status, changed, holder) = self.reserved.get(), self.claim.get()
            state = (payload, status, born, changed, holder, mode)
        known = state is not None
        for row in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            state, outcome = told(state, tuple(row[c] for c in EVENT))
            yield Row(**dict(zip(TOLD.names, outcome, strict=True)))
        if state is not None:
            payload, status, born, changed, holder, mode = state
            if not known:
                self.reserved.update((payload, born, mode))
                for seconds in (RETRIES + 1, KEEP):
                    self.handle.registerTimer((born + seconds) * 1000)
            self.claim.update((status, changed, holder))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N803
        if self.reserved.exists() and expiredTimerInfo.getExpiryTimeInMs() >= (self.reserved.get()[1] + KEEP) * 1000:
            self.reserved.clear()
            self.claim.clear()
        return iter(())

    def close(self) -> None:
        pass


class Intake(StatefulProcessor):
    """The first payload of a key is kept; the same one again is a replay, another a conflict.

    A key's submissions of one micro-batch are taken by event id.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N803
        kept = self.kept.get()[0] if self.kept.exists() else None
        first = not self.kept.exists()
        for row in sorted(rows, key=lambda r: r["event_id"]):
            outcome = "first" if first else "replay" if row["payload"] == kept else "conflict"
            if first:
                first, kept = False, row["payload"]
                self.kept.update((kept,))
            yield Row(event_id=row["event_id"], key=row["key"], outcome=outcome)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Several state variables and timers of a key need the RocksDB store; the setting is read as a query starts, then put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def committed(spark: SparkSession, folder: str, schema: Any) -> DataFrame:
    """The rows of the micro-batches that were committed, each once; what a batch that was cut off left behind is not read."""
    if not exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("path string").json(f"{folder}/commits").distinct()
    paths = sorted(r["path"] for r in done.collect())  # one for each micro-batch
    return spark.read.schema(schema).parquet(*paths)


def run_once(rows: DataFrame, folder: str, on_write: Callable[[int], None] | None = None) -> None:
    """Run a stream over what is there. A micro-batch writes a folder of its number anew, then a commit that names it.

    Killed between the two and run again, it overwrites its own rows; killed after the commit, its commit is written again
    and names the same folder. ``on_write`` is called between the two, for tests.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows/batch={number:09d}"
        batch.write.mode("overwrite").parquet(path)
        if on_write:
            on_write(number)
        batch.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder}/commits/batch={number:09d}")

    with state_store(rows.sparkSession):
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def source(spark: SparkSession, path: str, schema: Any, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def leases(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """``event_id, outcome, mode`` of a stream of ``events(key, event_id, at, kind, payload, token, receipt, mode)``, micro-batches in order of time.

    An event that comes more than ``delay`` after a later one is dropped by Spark, which counts it in the query's progress; a
    key is forgotten ``KEEP`` seconds of event time, and the delay, after its reservation. Null keys are one key.
    """
    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithState(Leases(), TOLD, "append", "EventTime")


def intake(submissions: DataFrame) -> DataFrame:
    """``event_id, key, outcome`` of a stream of ``submissions(event_id, key, payload)``, micro-batches in order of the ids."""
    return submissions.groupBy("key").transformWithState(Intake(), "event_id long, key string, outcome string", "append", "None")


def in_slices(rows: DataFrame, order: str, slices: int, folder: str) -> str:
    """A table as one file for each of ``slices`` ranges of ``order``, the oldest first, as a source of that many micro-batches."""
    least, most = rows.agg(F.min(order), F.max(order)).first()
    path = f"{folder}/source"
    step = 0 if least is None else (most - least) // slices + 1
    for i in range(slices):
        part = rows if least is None else rows.filter(F.col(order).between(least + i * step, least + (i + 1) * step - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def in_turn(rows: DataFrame, order: str, slices: int, folder: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stream`` commits over a table in ``slices`` ranges of ``order``, each a micro-batch that all tasks write and read.

    The table is worked out once and stored. A slice is put into the source when the one before it is through, so it may have
    any number of files and none is read with another's.
    """
    spark, path = rows.sparkSession, f"{folder}/source"
    rows.write.parquet(f"{folder}/table")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/table")
    least, most = kept.agg(F.min(order), F.max(order)).first()
    step = 0 if least is None else (most - least) // slices + 1
    for i in range(slices):
        part = kept if least is None else kept.filter(F.col(order).between(least + i * step, least + (i + 1) * step - 1))
        part.write.mode("append").parquet(path)
        out = stream(source(spark, path, rows.schema, files=2**31 - 1))
        run_once(out, folder)
    return committed(spark, folder, out.schema)
