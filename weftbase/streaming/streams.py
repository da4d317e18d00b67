"""Structured Streaming jobs: progress, errors, resources, alarms, idleness."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftbase.sources.scratch import scratch_path


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_by_key(stream: DataFrame, key: str = "chunk_id", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each key once: repeats whose time lies within ``late`` of the first are left out, across micro-batches and
    restarts; after that the key is forgotten and counts as new."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def interval_rates(stream: DataFrame, length: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per run and window of ``stream`` (run_id, ts, chunks): rows and the gain of the counter."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = stream.withWatermark("ts", late).groupBy("run_id", w.alias("w")).agg(F.count(F.lit(1)).alias("checks"), F.max("chunks").alias("high"), F.min("chunks").alias("low"))
    return rows.select("run_id", F.col("w.start").alias("begins"), "checks", (F.col("high") - F.col("low")).alias("gain"))


def error_rates(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Errors of each type per window."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "error_type").agg(F.count(F.lit(1)).alias("errors"), F.count_if(~F.col("recoverable")).alias("unrecoverable"))
    return rows.select(F.col("w.start").alias("begins"), "error_type", "errors", "unrecoverable")


def document_status(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Errors of each document (document_id, ts, recoverable) in each window, for update mode: a window's row comes
    again, with its new values, whenever it changes. State is bounded: a window is forgotten when the watermark has
    passed it, and rows behind that are left out. ``merge_status`` keeps the rows, ``status`` sums them up."""
    rows = stream.filter("document_id is not null").withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "document_id").agg(F.count(F.lit(1)).alias("errors"), F.max((~F.col("recoverable")).cast("int")).alias("failed"))
    return rows.select("document_id", F.col("w.start").alias("begins"), "errors", "failed")


STATUS = "document_id long, begins timestamp, errors long, failed int, batch long"


def merge_status(updates: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the newest row of each document and window under ``path``. A micro-batch writes its
    own folder, anew if it is repeated. Runs over all that is there, then ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(spark: SparkSession, path: str) -> DataFrame:
    """Per document: errors in all, whether one was for good, whether to retry it."""
    newest = spark.read.schema(STATUS).parquet(path).groupBy("document_id", "begins").agg(F.max_by(F.struct("errors", "failed"), "batch").alias("v"))
    rows = newest.groupBy("document_id").agg(F.sum("v.errors").alias("errors"), F.max("v.failed").alias("failed"))
    return rows.withColumn("retryable", F.col("failed") == 0)


def late_rows(stream: DataFrame, by: str = "run_id", late: str = "10 minutes") -> DataFrame:
    """How many rows of each ``by`` came behind the watermark, by micro-batch (append mode): those that windows of
    the same watermark may leave out. (Spark drops a row from a window that the watermark of the micro-batch before
    had passed.) Nothing is kept in state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        n = sum(int((pdf["ts"].dt.tz_localize(None) < mark).sum()) for pdf in parts)
        yield pd.DataFrame({by: [key[0]], "late": [n]} if n else {by: [], "late": []})

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, "ts").withWatermark("ts", late).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, late long", "unused int", "append", GroupStateTimeout.NoTimeout)


class _Trend(StatefulProcessor):
    """The last samples of a host and its last action; both go when the host falls silent."""

    def __init__(self, window: int, least: int, cooldown: int, silent: int) -> None:
        self.window, self.least, self.cooldown, self.silent = window, least, cooldown, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "mb double")
        self.last = handle.getValueState("last", "ts long, acted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.samples.get()]
        newest, acted = self.last.get() if self.last.exists() else (None, None)
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        seconds = _seconds(pdf["ts"])
        out = []
        for event, ts, mb in zip(pdf["event_id"].tolist(), seconds, pdf["mb"].tolist(), strict=True):
            if newest is not None and ts - newest > self.silent:
                held, acted = [], None
            held = [*held, float(mb)][-self.window :]
            half = len(held) // 2
            trend = round(sum(held[half:]) / (len(held) - half) - sum(held[:half]) / half, 6) if len(held) >= self.least else None
            act = trend is not None and trend > 10 and (acted is None or ts - acted >= self.cooldown)
            acted, newest = ts if act else acted, ts if newest is None else max(newest, ts)
            out.append((key[0], event, ts, trend, act))
        self.samples.put([(x,) for x in held])
        self.last.update((newest, acted))
        _alone(self.handle, (newest + self.silent) * 1000 + 1)
        yield pd.DataFrame(out, columns=["host", "event_id", "ts", "trend", "act"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.samples.clear()
        self.last.clear()
        return iter([])


class _Idle(StatefulProcessor):
    """When a run last worked, and whether it has been reported idle since."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, idle boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, idle = self.last.get() if self.last.exists() else (None, False)
        out = []
        for ts in sorted(x for pdf in rows for x in _seconds(pdf["ts"])):
            if newest is not None and ts - newest >= self.gap:
                out += [] if idle else [(key[0], newest + self.gap, "idle")]
                out.append((key[0], ts, "working"))
                idle = False
            newest = ts if newest is None else max(newest, ts)
        self.last.update((newest, idle))
        _alone(self.handle, None if idle else (newest + self.gap) * 1000)
        yield pd.DataFrame(out, columns=["run_id", "ts", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, _ = self.last.get()
        self.last.update((newest, True))
        yield pd.DataFrame([(key[0], newest + self.gap, "idle")], columns=["run_id", "ts", "state"])


def _seconds(ts: pd.Series) -> list[int]:
    """Whole seconds since 1970."""
    return (ts.dt.tz_localize(None).astype("datetime64[us]").astype("int64") // 1_000_000).tolist()


def _alone(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The only timer of the key from now on, in milliseconds."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


def memory_trends(stream: DataFrame, window: int = 15, least: int = 7, cooldown: int = 300, silent: int = 30 * 86_400, late: str = "10 minutes") -> DataFrame:
    """Per sample of ``stream`` (host, ts timestamp, event_id, mb): trend of the host's last samples, and whether to
    act on it: it rose by more than 10 MB and the last action lies ``cooldown`` seconds back.

    A host that sends nothing for more than ``silent`` seconds starts anew, and its state goes once the watermark
    has passed that time. Needs the RocksDB state store (``on_rocksdb``)."""
    rows = stream.withWatermark("ts", late).groupBy("host")
    return rows.transformWithStateInPandas(_Trend(window, least, cooldown, silent), "host long, event_id long, ts long, trend double, act boolean", "append", "eventTime")


def idle_states(stream: DataFrame, gap: int = 600, late: str = "10 minutes") -> DataFrame:
    """When each run of ``stream`` (run_id, ts timestamp) falls idle, ``gap`` seconds after its last work, and when it
    works again: run_id, ts seconds, state. The idle row comes as soon as the watermark has passed the gap, also
    when the run sends nothing more. Needs the RocksDB state store (``on_rocksdb``)."""
    rows = stream.withWatermark("ts", late).groupBy("run_id")
    return rows.transformWithStateInPandas(_Idle(gap), "run_id long, ts long, state string", "append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB: on disk, and saved by changes."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def failure_alarms(stream: DataFrame, failures: int = 3) -> DataFrame:
    """Per store of ``stream`` (store_id, ts seconds, ok): an alert after so many failures in a row, which then
    count anew."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = state.get[0] if state.exists else 0
        pdf = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(pdf["ts"], pdf["ok"], strict=True):
            row = 0 if ok else row + 1
            if row >= failures:
                out.append((key[0], int(ts)))
                row = 0
        state.update((row,))
        yield pd.DataFrame(out, columns=["store_id", "ts"])

    return stream.groupBy("store_id").applyInPandasWithState(run, "store_id long, ts long", "in_a_row int", "append", GroupStateTimeout.NoTimeout)


def work_sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of work of each run; a longer gap means idle."""
    rows = stream.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("run_id", F.col("w.start").alias("begins"), "events")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result as a table in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    spark.createDataFrame([], stream.schema).write.parquet(out)
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
