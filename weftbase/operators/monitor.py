"""Monitoring: rates, bottlenecks, alarms, memory trends, error rollups. Windows are always per run or host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(progress: DataFrame, total: int) -> DataFrame:
    """``progress`` (run_id, ts seconds, chunks) with change, seconds, rate and ETA since the check before, and
    the rate a minute since the run began."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = progress.withColumns({"change": F.col("chunks") - F.lag("chunks").over(w), "seconds": F.col("ts") - F.lag("ts").over(w), "begun": F.first("ts").over(w)})
    rate = F.when(F.col("seconds") > 0, F.col("change") / F.col("seconds"))
    rows = rows.withColumn("rate", F.round(rate, 6))
    eta = F.when(F.col("rate") > 0, F.floor((total - F.col("chunks")) * F.col("seconds") / F.col("change")))
    overall = F.when(F.col("ts") > F.col("begun"), F.round(F.lit(60.0) * F.col("chunks") / (F.col("ts") - F.col("begun")), 6))
    return rows.withColumns({"eta_s": eta, "per_minute": overall}).drop("begun")


def bottlenecks(rated: DataFrame, slow: float = 0.1, after: int = 3, errors: int = 5) -> DataFrame:
    """Flags of each check: low rate after the first checks, no progress since the last, many errors so far."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = rated.withColumns({"check": F.row_number().over(w), "errors": F.sum("is_error").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.withColumns({
        "low_rate": (F.col("check") > after) & (F.coalesce("rate", F.lit(0.0)) < slow), "no_progress": F.coalesce(F.col("change") == 0, F.lit(False)), "many_errors": F.col("errors") > errors,
    })


def loss_alarm(checks: DataFrame, drop: float = 0.10, failures: int = 3) -> DataFrame:
    """``checks`` (store_id, ts, event_id, chunks) with healthy, failures in a row and alert. A check fails when
    the count fell by more than ``drop`` from the last healthy one; after ``failures`` in a row comes an
    alert, and counting starts anew. Health depends on earlier health: one pass per store in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        last, row, out = None, 0, []
        for n in pdf["chunks"]:
            ok = last is None or n >= last * (1 - drop)
            row = 0 if ok else row + 1
            alert = row >= failures
            out.append((ok, row, alert))
            last = n if ok else last
            row = 0 if alert else row
        pdf[["healthy", "in_a_row", "alert"]] = pd.DataFrame(out, index=pdf.index)
        return pdf[["store_id", "ts", "event_id", "chunks", "healthy", "in_a_row", "alert"]]

    return checks.groupBy("store_id").applyInPandas(run, "store_id long, ts long, event_id long, chunks long, healthy boolean, in_a_row int, alert boolean")


def memory_trend(samples: DataFrame, window: int = 15, least: int = 7) -> DataFrame:
    """``samples`` (host, ts, event_id, mb) with trend: later half less earlier half of the last samples, and
    its label (leak over 20 MB, increasing over 10, decreasing under -10, else stable)."""
    w = Window.partitionBy("host").orderBy("ts", "event_id").rowsBetween(-(window - 1), 0)
    rows = samples.withColumn("_s", F.collect_list("mb").over(w))
    n = F.size("_s")
    half = F.floor(n / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    trend = F.when(n >= least, F.round(mean(F.slice("_s", half + 1, n - half)) - mean(F.slice("_s", F.lit(1), half)), 6))
    rows = rows.withColumn("trend", trend).drop("_s")
    label = F.when(F.col("trend").isNull(), "unknown").when(F.col("trend") > 20, "leak").when(F.col("trend") > 10, "increasing").when(F.col("trend") < -10, "decreasing").otherwise("stable")
    return rows.withColumn("label", label)


def batch_mode(cpu: Column, memory: Column) -> Column:
    """Struct of batch size and mode for CPU and memory in percent: one more than the whole tenths left, as doubles
    have them (80 percent leave 0.19999999999999996, hence 1)."""
    free = F.least(1 - cpu.cast("double") / 100, 1 - memory.cast("double") / 100) * 10
    size = F.when((cpu > 85) | (memory > 85), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), (F.floor(free) + 1).cast("int"))))
    mode = F.when((cpu > 85) | (memory > 85), "single").when(size >= 6, "batch").otherwise("careful")
    return F.struct(size.cast("int").alias("batch_size"), mode.alias("mode"))


def duration_text(seconds: Column) -> Column:
    """``d h m``, ``h m`` or ``m s``."""
    s = F.floor(seconds).cast("long")
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(days > 0, F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(minutes, "m"))).when(hours > 0, F.concat_ws(" ", part(hours, "h"), part(minutes, "m"))).otherwise(F.concat_ws(" ", part(minutes, "m"), part(s % 60, "s")))


def eta_timestamp(now: Column, seconds: Column) -> Column:
    return now + F.make_interval(secs=seconds)


def error_rollup(errors: DataFrame) -> DataFrame:
    """Errors in all and by type, with how many could be recovered (rows with a document only)."""
    known = F.col("document_id").isNotNull()
    return errors.rollup("error_type").agg(F.count(F.lit(1)).alias("errors"), F.count_if(known & F.col("recoverable")).alias("recoverable"), F.count_if(known & ~F.col("recoverable")).alias("unrecoverable"))


def document_errors(errors: DataFrame) -> DataFrame:
    """Per document: its errors, whether it failed for good, whether to retry it."""
    rows = errors.filter("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("errors"), F.bool_or(~F.col("recoverable")).alias("failed"))
    return rows.withColumn("retryable", ~F.col("failed"))


def batch_outcomes(results: DataFrame) -> DataFrame:
    """Per batch: counts of outcomes, failed ids, chunks a second. ``results``: batch_id, chunk_id, outcome, seconds."""
    count = lambda v: F.count_if(F.col("outcome") == v)
    rows = results.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), count("ok").alias("successful"), count("failed").alias("failed"), count("skipped").alias("skipped"), F.sum("seconds").alias("_s"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.col("chunk_id")))).alias("_f"))
    return rows.select("batch_id", "total", "successful", "failed", "skipped", F.array_join(F.transform("_f", lambda x: x.cast("string")), ",").alias("failed_ids"), F.round(F.when(F.col("_s") > 0, F.col("successful") / F.col("_s")).otherwise(0.0), 6).alias("per_second"))
