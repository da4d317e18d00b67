"""Incremental ingest: documents that come in are chunked and embedded, and each chunk is stored once.

Each micro-batch is a step of a ledger (``sources.ledger``), so a stream that stopped anywhere between reading and
the checkpoint's commit gives, started again, the rows that it would have given. The store is split by ranges of
the key: a micro-batch looks for what is held already in the ranges it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.functions.text import fixed_chunks
from weftbase.operators.embed import Embedder, embed_once
from weftbase.operators.store import guarded
from weftbase.sources import ledger
from weftbase.sources.scratch import keep

#: Ranges that are listed in a filter; more are bounded by the least and the largest.
LISTED = 1_000
CHUNKS_OF_A_DOCUMENT = 1_000_000
CHUNKS = "chunk_id long, document_id long, chunk_index int, text string, vector array<float>, error string"


def chunked(documents: DataFrame, make: Callable[[], Embedder], dim: int, size: int = 1500, overlap: int = 150) -> DataFrame:
    """CHUNKS of documents (id, text). A chunk's id is that of its document and its place there. Null, empty and
    very short texts give none; a text that fails to embed has the zero vector and its error."""
    cut = documents.select(F.col("id").cast("long").alias("document_id"), F.explode(fixed_chunks(F.col("text"), size, overlap)).alias("c"))
    rows = cut.select((F.col("document_id") * CHUNKS_OF_A_DOCUMENT + F.col("c.pos")).alias("chunk_id"), "document_id", F.col("c.pos").alias("chunk_index"), F.col("c.text").alias("text"))
    return embed_once(guarded(rows), make, dim).select(*[c.split()[0] for c in CHUNKS.split(", ")])


def stored(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    """What has been ingested into ``path``."""
    return ledger.visible(_written(spark, path, schema), f"{path}/ledger").select(*[c.split()[0] for c in schema.split(", ")])


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    columns = f"{schema}, key_range long, attempt string"
    spark.createDataFrame([], columns).write.mode("append").partitionBy("key_range", "attempt").parquet(f"{path}/rows")
    return spark.read.schema(columns).parquet(f"{path}/rows")


def ingest(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, name: str = "ingest", schema: str = CHUNKS, key: str = "chunk_id", width: int = 1_000 * CHUNKS_OF_A_DOCUMENT):
    """Start a query that stores ``work`` of each micro-batch: rows of ``schema`` with a whole number as ``key``,
    of which each is stored once. ``width``: keys of a range. Runs over all that is there, then ends.

    ``name`` and ``checkpoint`` belong together: a stream with a new checkpoint takes a new name, and finds what
    others have stored. Rows without a key are left out; of rows with the same key any one is stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, step = batch.sparkSession, f"{name}.{number}"
        if step in ledger.steps(spark, f"{path}/ledger", step):
            return
        made = work(batch).filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("key_range", F.floor(F.col(key) / width))
        rows = keep(made, "batch")
        touched = [r["key_range"] for r in rows.select("key_range").distinct().limit(LISTED + 1).collect()]
        if len(touched) > LISTED:
            least, most = rows.agg(F.min("key_range"), F.max("key_range")).head()
            near = F.col("key_range").between(least, most)
        else:
            near = F.col("key_range").isin(touched)
        held = ledger.visible(_written(spark, path, schema).filter(near), f"{path}/ledger").select(key)
        attempt = ledger.attempt()
        rows.join(held, key, "left_anti").withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("key_range", "attempt").parquet(f"{path}/rows")
        ledger.commit(spark, f"{path}/ledger", step, attempt, _written(spark, path, schema).filter(F.col("attempt") == attempt).count())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
