"""Jobs that are killed and started again: nothing twice, nothing lost, nothing done again that was committed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftbase.operators import embed, rebuild
from weftbase.sources import ledger
from weftbase.streaming import ingest, streams


class Killed(Exception):
    pass


def counted(folder):
    """An embedder that notes each text it gets in a file of its own."""

    def make():
        import uuid

        def run(texts):
            if "fail" in texts:
                raise ValueError("no vector for this")
            for t in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return np.ones((len(texts), 4))

        return run

    return make


def seen(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def dies(monkeypatch, when, after=False):
    """The commit of the ``when``-th step from now on is never made, or is the last thing that is done."""
    commit, at = ledger.commit, [0]

    def run(*a):
        at[0] += 1
        if at[0] == when and not after:
            raise Killed
        commit(*a)
        if at[0] == when:
            raise Killed

    monkeypatch.setattr(ledger, "commit", run)


DOCS = [(1, "first text of some length " * 100), (2, "second text, rather short"), (3, "tiny"), (4, None), (5, "third text of some length")]


def rows_of(df):
    return sorted((r["chunk_id"], r["text"]) for r in df.select("chunk_id", "text").collect())


@pytest.mark.parametrize("after", [False, True])
def test_ingest_killed_and_started_again(spark, tmp_path, monkeypatch, after):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    docs.filter("id <= 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    docs.filter("id > 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "seen").mkdir()
    make = counted(str(tmp_path / "seen"))
    run = lambda name="a": ingest.ingest(streams.read_stream(spark, str(tmp_path / "in"), "id long, text string", 1), lambda b: ingest.chunked(b, make, 4), str(tmp_path / "out"), str(tmp_path / f"checkpoint-{name}"), name)
    with monkeypatch.context() as m:
        dies(m, 1, after)
        with pytest.raises(Exception, match="Killed"):
            run().awaitTermination()
    assert len(rows_of(ingest.stored(spark, str(tmp_path / "out")))) in ((2, 1, 3) if after else (0,))
    run().awaitTermination()
    expected = rows_of(ingest.chunked(docs, make, 4))
    assert rows_of(ingest.stored(spark, str(tmp_path / "out"))) == expected and len(expected) == 4
    run("b").awaitTermination()
    assert rows_of(ingest.stored(spark, str(tmp_path / "out"))) == expected


def test_ingest_takes_new_and_repeated_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LISTED", 1)
    run = lambda: ingest.ingest(streams.read_stream(spark, str(tmp_path / "in"), "id long, text string"), lambda b: ingest.chunked(b, lambda: embed.hashing_embedder(4), 4), str(tmp_path / "out"), str(tmp_path / "c"), width=ingest.CHUNKS_OF_A_DOCUMENT).awaitTermination()
    for part in (DOCS[:3], DOCS[1:], DOCS):
        spark.createDataFrame(part, "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = ingest.stored(spark, str(tmp_path / "out"))
    assert rows_of(got) == rows_of(ingest.chunked(spark.createDataFrame(DOCS, "id long, text string"), lambda: embed.hashing_embedder(4), 4))
    plan = ingest._written(spark, str(tmp_path / "out"), ingest.CHUNKS).filter(F.col("key_range").isin([1]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(key_range" in plan


def test_rebuild_embeds_only_what_is_left(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"d{i}.pdf") for i in range(4)], "id long, filename string")
    texts = [f"text number {i % 15} of a chunk" for i in range(30)]
    rows = [(i, i % 5, i, t) for i, t in enumerate(texts)] + [(98, 1, 98, "short"), (99, 2, 99, None)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index long, text_content string")
    (tmp_path / "seen").mkdir()
    run = lambda job="j", c=chunks: rebuild.rebuild(docs, c, str(tmp_path / "store"), job, counted(str(tmp_path / "seen")), 4, waves=4)
    with monkeypatch.context() as m:
        dies(m, 4, after=True)
        with pytest.raises(Killed):
            run()
    half = seen(tmp_path / "seen")
    with pytest.raises(KeyError):
        rebuild.rebuilt(spark, str(tmp_path / "store"), "j")
    kept = {t for i, t in enumerate(texts) if i % 5 < 4}
    assert 0 < len(half) < len(kept)
    made = run()
    assert seen(tmp_path / "seen") == sorted(kept)
    assert sorted((r["document_id"], r["chunk_index"], r["filename"], len(r["vector"])) for r in made.collect()) == sorted((i % 5, i, f"d{i % 5}.pdf", 4) for i in range(30) if i % 5 < 4)
    run()
    more = chunks.union(spark.createDataFrame([(200, 0, 200, "a new text of a chunk"), (201, 0, 201, texts[0])], chunks.schema))
    assert run("next", more).count() == made.count() + 2
    assert seen(tmp_path / "seen") == sorted([*kept, "a new text of a chunk"])


def test_rebuild_keeps_failures_apart(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a.pdf")], "id long, filename string")
    chunks = spark.createDataFrame([(0, 0, 0, "a text that works"), (1, 0, 1, "fail")], "id long, document_id long, chunk_index long, text_content string").withColumn("text_content", F.when(F.col("id") == 1, "fail" + " " * 10).otherwise(F.col("text_content")))
    make = lambda: lambda texts: np.ones((len(texts), 2)) if not any(t.startswith("fail") for t in texts) else 1 / 0
    got = {r["chunk_index"]: r for r in rebuild.rebuild(docs, chunks, str(tmp_path / "s"), "one", make, 2, waves=2).collect()}
    assert got[0]["error"] is None and got[1]["error"] and got[1]["vector"] == [0.0, 0.0]
    again = rebuild.rebuild(docs, chunks, str(tmp_path / "s"), "two", lambda: lambda texts: np.ones((len(texts), 2)), 2, waves=2)
    assert all(r["error"] is None and r["vector"] == [1.0, 1.0] for r in again.collect())
