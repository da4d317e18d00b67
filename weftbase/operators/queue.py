"""Work queues and paging over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftbase import schemas
from weftbase.operators.profile import documents_with_counts
from weftbase.sources.scratch import keep


def processing_state(c: Column) -> Column:
    """Parsed state; broken or missing JSON is status ``unknown``."""
    state = F.from_json(c, schemas.PROCESSING_STATE)
    good = state["status"].isNotNull()
    return F.when(good, state).otherwise(F.struct(F.lit(None).cast("int").alias("total_chunks"), F.lit(None).cast("int").alias("processed_chunks"), F.lit("unknown").alias("status")))


def state_percent(state: Column) -> Column:
    total = state["total_chunks"]
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.floor(F.lit(100.0) * state["processed_chunks"] / total)).otherwise(F.lit(0)).cast("int")


def loadable(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Processed websites with more content than they have chunks."""
    return documents_with_counts(documents.filter("file_type = 'website' and processed and file_size > 0"), chunks).filter("file_size > chunks")


def next_work(documents: DataFrame, limit: int = 5) -> DataFrame:
    """Documents to work on: of those begun if there are any, else of those not begun; by id."""
    rows = documents.filter("not processed").withColumn("class", F.when(F.col("processing_state").isNotNull(), 0).otherwise(1))
    return rows.orderBy("class", "id").limit(limit).withColumn("_first", F.min("class").over(Window.partitionBy())).filter("class = _first").drop("_first")


def page_after(rows: DataFrame, last: int, n: int, key: str = "id") -> DataFrame:
    return rows.filter(F.col(key) > last).orderBy(key).limit(n)


def listing(documents: DataFrame, chunks: DataFrame, page: int, size: int) -> DataFrame:
    """A page of documents, the newest first, with chunk counts and the number of pages."""
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    shown = documents.orderBy(F.desc("created_s"), "id").offset((page - 1) * size).limit(size)
    counts = chunks.join(shown.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rows = documents_with_counts(shown, counts).crossJoin(total)
    return rows.withColumn("pages", F.floor((F.col("total") + size - 1) / size).cast("long"))


def recent(documents: DataFrame, n: int = 5) -> DataFrame:
    return documents.orderBy(F.desc("created_s"), F.desc("id")).limit(n)


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_range``: ranges of ``key`` in its order, one a shuffle partition. They are written to the
    shared folder, since a second pass could draw other borders."""
    return keep(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranged")


def next_chunk(chunks: DataFrame) -> DataFrame:
    """The chunk that follows each one: in its document, else the first of the next document with chunks. The
    last document of a range looks to the first of the next range."""
    within = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.withColumn("next_id", F.lead("id").over(within))
    firsts = ranged(chunks.groupBy("document_id").agg(F.min_by("id", "chunk_index").alias("first_id")), "document_id")
    borders = firsts.groupBy("_range").agg(F.min_by("first_id", "document_id").alias("_head"))
    borders = borders.select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_border"))
    after = F.coalesce(F.lead("first_id").over(Window.partitionBy("_range").orderBy("document_id")), F.col("_border"))
    heads = firsts.join(borders, "_range").select("document_id", after.alias("_after"))
    return rows.join(heads, "document_id").select("id", "document_id", "chunk_index", F.coalesce("next_id", "_after").alias("next_id"))


def ordinals(chunks: DataFrame) -> DataFrame:
    """Document-wide ordinal from page-local chunk indexes."""
    w = Window.partitionBy("document_id").orderBy("page_number", "chunk_index")
    return chunks.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def increment(chunks: DataFrame, counts: DataFrame, step: int = 100) -> DataFrame:
    """The next ``step`` chunks of each document after the ``loaded`` ones (document_id, loaded)."""
    rows = ordinals(chunks).join(counts, "document_id")
    return rows.filter((F.col("ordinal") >= F.col("loaded")) & (F.col("ordinal") < F.col("loaded") + step))


def until_target(chunks: DataFrame, done: DataFrame, percent: float) -> DataFrame:
    """The pending chunks, by id, that bring the share done to the target. Counts of ranges of ids, summed, say
    how many each range gives; rows are ranked within their range only."""
    need = chunks.agg((F.count(F.lit(1)) * F.lit(percent / 100.0)).cast("long").alias("n")).crossJoin(done.agg(F.count(F.lit(1)).alias("d")))
    pending = ranged(chunks.join(done, chunks["id"] == done["chunk_id"], "left_anti").select("id", "document_id"), "id")
    sizes = pending.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    gives = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).crossJoin(need).select("_range", (F.col("n") - F.col("d") - F.col("_before")).alias("_gives")).filter("_gives > 0")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return pending.join(gives, "_range").withColumn("_nth", nth).filter("_nth <= _gives").select("id", "document_id")
