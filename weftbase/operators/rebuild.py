"""Full rebuild of the chunk store: chunk texts embedded once each, in waves that are committed one by one.

Killed at any point and started again under the same name, a job goes on after its last committed wave. Vectors are
kept by the text they belong to, so that a later rebuild embeds new texts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.functions.text import text_key
from weftbase.operators.embed import Embedder, embedded
from weftbase.operators.store import rebuilt_entries
from weftbase.sources import ledger

VECTORS = "text_key string, vector array<float>, error string"
PENDING = "text_key string, text string, wave int"


def rebuild(documents: DataFrame, chunks: DataFrame, path: str, job: str, make: Callable[[], Embedder], dim: int, waves: int = 16, most: int = 4_000) -> DataFrame:
    """The new store: every chunk of a known document with the document's columns, ``vector`` and ``error``.

    ``path`` holds the ledger, the vectors and each job's store. Of a text the first ``most`` characters are
    embedded. Texts that fail get the zero vector and their error, and are tried again by the next job. A wave is
    a share of the distinct texts by hash: its size is what a death can cost.
    """
    spark, log = documents.sparkSession, f"{path}/ledger"
    done = ledger.steps(spark, log, f"{job}.")
    keyed = rebuilt_entries(documents, chunks).withColumn("text_key", text_key(F.substring("text", 1, most)))
    if f"{job}.pending" not in done:
        known = ledger.visible(ledger.folder(spark, f"{path}/vectors", VECTORS), log).filter("error IS NULL").select("text_key")
        texts = keyed.select("text_key", F.substring("text", 1, most).alias("text")).dropDuplicates(["text_key"])
        todo = texts.join(known, "text_key", "left_anti").withColumn("wave", F.pmod(F.xxhash64("text_key"), F.lit(waves)).cast("int"))
        name = ledger.attempt()
        todo.repartition("wave", F.pmod(F.hash("text_key"), F.lit(32))).write.partitionBy("wave").parquet(f"{path}/pending/attempt={name}")
        ledger.commit(spark, log, f"{job}.pending", name, 0)
        done[f"{job}.pending"] = name
    pending = spark.read.schema(PENDING).parquet(f"{path}/pending/attempt={done[f'{job}.pending']}")
    for wave in range(waves):
        if f"{job}.wave-{wave}" in done:
            continue
        name = ledger.attempt()
        made = pending.filter(F.col("wave") == wave).select("text_key", embedded(F.col("text"), make, dim).alias("r"))
        made.select("text_key", "r.vector", "r.error").write.parquet(f"{path}/vectors/attempt={name}")
        ledger.commit(spark, log, f"{job}.wave-{wave}", name, 0)
    if f"{job}.store" not in done:
        name = ledger.attempt()
        vectors = ledger.visible(ledger.folder(spark, f"{path}/vectors", VECTORS), log)
        # an earlier job's failure may have been mended since
        vectors = vectors.groupBy("text_key").agg(F.min_by(F.struct("vector", "error"), F.col("error").isNotNull()).alias("v"))
        keyed.join(vectors, "text_key").select(*keyed.drop("text_key").columns, "v.vector", "v.error").write.parquet(f"{path}/store/attempt={name}")
        ledger.commit(spark, log, f"{job}.store", name, 0)
    return rebuilt(spark, path, job)


def rebuilt(spark: SparkSession, path: str, job: str) -> DataFrame:
    """The store that a job has made; KeyError if it has not come to its end."""
    name = ledger.steps(spark, f"{path}/ledger", f"{job}.store")[f"{job}.store"]
    return spark.read.parquet(f"{path}/store/attempt={name}")
