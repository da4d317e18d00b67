"""Very many matches in one text: time in proportion, the same spans and the same redacted text as a loop's."""

import random
import re
import time

from pyspark.sql import functions as F

from weftbase.llm import secrets


def test_a_hundred_thousand_matches(spark):
    rng = random.Random(4)
    words = [f"{rng.getrandbits(72):018x}" if i % 3 else f"é token={'ab1' * 5}" for i in range(100_000)]
    text = " and ".join(words)
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    found = secrets.find_secrets(docs)
    found = found.withColumn("redacted", secrets.redact(F.col("text"), F.col("secrets")))
    rows = {r["doc_id"]: r for r in found.select("doc_id", "n_hex", "n_assign", F.transform("secrets", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"), F.md5(F.col("redacted").cast("binary")).alias("md5")).collect()}
    assert time.perf_counter() - began < 60
    spans = sorted([(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]{16,}", text)] + [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"token=[a-z0-9]{12,}", text)])
    assert rows[1]["n_hex"] + rows[1]["n_assign"] == len(spans) >= 100_000
    assert [tuple(s) for s in rows[1]["spans"]] == [(a, b, k) for a, _, b, k in spans]
    from hashlib import md5

    assert rows[1]["md5"] == md5(re.sub(r"[0-9a-f]{16,}|token=[a-z0-9]{12,}", "[SECRET]", text).encode()).hexdigest()
    assert rows[2]["spans"] == [] and rows[3]["md5"] is None


def test_running(spark):
    values = [random.Random(1).randrange(50) for _ in range(1_000)]
    df = spark.createDataFrame([(values,), ([],), ([7],)], "v array<int>")
    got = df.select(secrets.running(F.col("v"), lambda a, b: a + b).alias("s"), secrets.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    assert got[0]["s"] == [sum(values[: i + 1]) for i in range(1_000)] and got[0]["m"] == [max(values[: i + 1]) for i in range(1_000)]
    assert got[1]["s"] == [] and got[2]["m"] == [7]


def test_overlapping_spans(spark):
    spans = [(2, 5), (3, 4), (5, 7), (6, 9), (12, 13)]
    df = spark.createDataFrame([("0123456789abcdef", spans), ("xy", [(0, 2)])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(secrets.redact(F.col("t"), F.col("s"), "#")).collect()] == ["01##9ab#def", "#"]
