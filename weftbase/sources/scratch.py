"""The folder that the whole cluster shares, for checkpoints and tables between steps."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names it; else a folder of the warehouse.

    Only a session in local mode, where one machine does everything, gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", f"file://{made}")
        return f"file://{made}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path. Those of an application that has ended can be deleted: ``<dir>/<application id>/``."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return it as read from there: its lineage ends,
    and a lost executor costs no work before this point. ``free``: have the driver collect its garbage, upon
    which Spark deletes the shuffle files of steps that nothing refers to any more; the plans of many small steps
    would otherwise make its heap grow."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
