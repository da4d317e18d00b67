"""What a restartable job has done: a row for each step it has committed, beside the tables it writes.

A step first writes its rows under a name that no other attempt has, then commits that name. Readers take
committed names only, so what an attempt that died has left is never seen, and a step done twice counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "attempt string, rows long, step string"


def attempt() -> str:
    """A name for what one try of a step writes."""
    return uuid.uuid4().hex


def commit(spark: SparkSession, path: str, step: str, attempt: str, rows: int) -> None:
    """From now on what ``attempt`` has written counts."""
    spark.createDataFrame([(attempt, rows)], "attempt string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The committed steps; a new ledger has none but its own first row."""
    spark.createDataFrame([("", 0)], "attempt string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/step=opened")
    return spark.read.schema(COLUMNS).parquet(path)


def steps(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """Attempt of each committed step whose name begins so: as many as the job has steps, whatever the data."""
    rows = opened(spark, path).filter(F.startswith("step", F.lit(prefix))).collect()
    return {r["step"]: r["attempt"] for r in rows}


def visible(rows: DataFrame, path: str) -> DataFrame:
    """Rows (with their ``attempt``) of committed attempts."""
    return rows.join(opened(rows.sparkSession, path).select("attempt"), "attempt", "left_semi")


def folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder by attempt, committed or not; it is made if it is not there."""
    spark.createDataFrame([], schema).limit(0).write.mode("append").parquet(f"{path}/attempt=none")
    return spark.read.schema(f"{schema}, attempt string").parquet(path)
