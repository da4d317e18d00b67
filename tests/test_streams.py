"""Streams with state over several micro-batches and restarts: late and repeated rows, timers, state that goes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftbase.operators import monitor
from weftbase.streaming import streams


def at(seconds):
    return dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


class Runs:
    """A folder of arriving files, and a stream over it with one checkpoint."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n, self.out = spark, tmp_path, schema, make, 0, []

    def arrive(self, *rows):
        """One file is one micro-batch."""
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n:03}")
        return self

    def run(self, mode="append"):
        got = []
        stream = self.make(streams.read_stream(self.spark, f"{self.path}/in/*", self.schema, 1))
        write = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: got.extend(tuple(r) for r in df.collect()))
        query = write.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress = query.recentProgress
        return sorted(got, key=repr)

    def held(self):
        """Keys in the state after the last micro-batch."""
        return [s["numRowsTotal"] for p in self.progress for s in p["stateOperators"]][-1]


def test_once_by_key_across_restarts(spark, tmp_path):
    runs = Runs(spark, tmp_path, "chunk_id long, ts timestamp", lambda s: streams.once_by_key(s, late="1 hour").select("chunk_id"))
    assert runs.arrive((1, at(0)), (2, at(5)), (1, at(9))).arrive((1, at(600)), (3, at(700))).run() == [(1,), (2,), (3,)]
    assert runs.arrive((2, at(1800)), (4, at(900))).run() == [(4,)]
    # an hour after the first the key is forgotten, and the state of the old ones goes
    assert runs.arrive((9, at(20_000))).run() == [(9,)]
    assert runs.arrive((1, at(20_100)), (3, at(100))).run() == [(1,)]
    assert runs.held() <= 3


def test_sliding_rates_and_late_rows(spark, tmp_path):
    schema = "run_id long, ts timestamp, chunks long"
    runs = Runs(spark, tmp_path, schema, lambda s: streams.interval_rates(s, "60 seconds", "30 seconds", "60 seconds").withColumn("begins", F.unix_seconds("begins") - int(at(0).timestamp())))
    runs.arrive((1, at(10), 5), (1, at(40), 9)).arrive((1, at(70), 20), (1, at(400), 21)).arrive((1, at(405), 25)).arrive((1, at(20), 999), (1, at(410), 30))
    got = runs.run()
    assert [r for r in got if r[1] < 90] == [(1, -30, 1, 0), (1, 0, 2, 4), (1, 30, 2, 11), (1, 60, 1, 0)]
    late = Runs(spark, tmp_path / "late", schema, lambda s: streams.late_rows(s, late="60 seconds"))
    late.arrive((1, at(10), 5), (1, at(400), 21)).arrive((1, at(20), 999), (1, at(338), 1), (2, at(339), 1), (2, at(341), 0), (1, at(410), 30))
    assert late.run() == [(1, 2), (2, 1)]
    assert late.arrive((2, at(349), 0), (2, at(350), 0), (3, at(900), 0)).run() == [(2, 1)]


def test_memory_trends_as_in_batch_and_silent_hosts(spark, tmp_path):
    schema = "host long, ts timestamp, event_id long, mb double"
    runs = Runs(spark, tmp_path, schema, lambda s: streams.memory_trends(s, silent=3600, late="10 seconds"))
    rows = [(h, at(60 * i), 100 * h + i, float((i * i * (h + 3)) % 97)) for h in (1, 2) for i in range(40)]
    batches = [rows[:25] + rows[40:65], rows[25:40] + rows[65:80]]
    with streams.on_rocksdb(spark):
        got = runs.arrive(*batches[0]).run() + runs.arrive(*batches[1]).run()
        batch = monitor.memory_trend(spark.createDataFrame(rows, schema).withColumn("ts", F.unix_seconds("ts")))
        assert sorted((r[0], r[1], r[3]) for r in got) == sorted((r["host"], r["event_id"], r["trend"]) for r in batch.collect())
        acted = {h: [r[2] for r in sorted(got, key=lambda r: r[2]) if r[0] == h and r[4]] for h in (1, 2)}
        assert all(len(a) > 1 and min(y - x for x, y in zip(a, a[1:], strict=False)) >= 300 for a in acted.values())
        # host 1 goes on, host 2 falls silent and leaves nothing; when it comes back it starts anew
        runs.arrive((1, at(60 * 40 + 3000), 900, 1.0)).run()
        before = runs.held()
        runs.arrive((1, at(60 * 40 + 6000), 901, 1.0)).run()
        runs.arrive((1, at(60 * 40 + 6060), 902, 1.0)).run()
        assert runs.held() < before
        assert [r[3] for r in runs.arrive((2, at(60 * 40 + 6100), 903, 1.0)).run()] == [None]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != streams.ROCKSDB


def test_idle_rows_come_while_nothing_does(spark, tmp_path):
    runs = Runs(spark, tmp_path, "run_id long, ts timestamp", lambda s: streams.idle_states(s, 600, "10 seconds"))
    zero = int(at(0).timestamp())
    with streams.on_rocksdb(spark):
        first = runs.arrive((1, at(0)), (1, at(100)), (2, at(50)), (2, at(900))).run()
        # run 1 sends nothing, but the watermark has passed its gap; run 2 was idle between two rows
        assert first == [(1, zero + 700, "idle"), (2, zero + 650, "idle"), (2, zero + 900, "working")]
        assert runs.arrive((2, at(1000))).run() == []
        assert runs.arrive((1, at(1500)), (2, at(1550))).run() == [(1, zero + 1500, "working")]
        assert runs.arrive((3, at(5000))).run() == [(1, zero + 2100, "idle"), (2, zero + 2150, "idle")]


@pytest.mark.parametrize("again", [False, True])
def test_document_status_in_bounded_state(spark, tmp_path, again):
    schema = "document_id long, ts timestamp, recoverable boolean"
    rows = [(i % 7 if i % 5 else None, at(40 * i), i % 11 != 0) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = str(tmp_path / "out")
    run = lambda c: streams.merge_status(streams.document_status(streams.read_stream(spark, f"{tmp_path}/in/*", schema, 1)), out, f"{tmp_path}/{c}")
    query = run("c")
    query.awaitTermination()
    if again:
        run("other").awaitTermination()  # the same micro-batches once more
    expected = monitor.document_errors(spark.createDataFrame(rows, schema))
    assert sorted((r["document_id"], r["errors"], r["failed"] == 1, r["retryable"]) for r in streams.status(spark, out).collect()) == sorted((r["document_id"], r["errors"], r["failed"], r["retryable"]) for r in expected.collect())
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert states[-1] < 7 * 3 and spark.read.parquet(out).select("document_id", "begins").distinct().count() > 7 * 3
