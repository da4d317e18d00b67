"""Statistics of documents, chunks and entries: each one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftbase.functions.text import origin


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """Part of whole in percent; 0 of nothing."""
    return F.round(F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole), digits)


def corpus_stats(documents: DataFrame, chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """One row: documents, pdfs, websites, chunks, collections."""
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("file_type") == "pdf").alias("pdfs"), F.count_if(F.col("file_type") == "website").alias("websites"))
    return d.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(collections.agg(F.count(F.lit(1)).alias("collections")))


def store_stats(entries: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct PDF titles and website origins."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return entries.agg(count(F.when(F.col("source_type") == "pdf", F.col("title"))).alias("pdf_titles"), count(F.when(F.col("source_type") == "website", origin(F.col("url")))).alias("origins"), F.count(F.lit(1)).alias("entries"))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


def documents_with_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its number of chunks, which can be 0."""
    counts = chunks_per_document(chunks).withColumnRenamed("document_id", "id")
    return documents.join(counts, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def top_documents(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks_per_document(chunks).orderBy(F.desc("chunks"), "document_id").limit(n)


def chunk_average(chunks: DataFrame) -> DataFrame:
    """Documents with chunks, and chunks per such document."""
    return chunks_per_document(chunks).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("chunks"), 6).alias("average"), F.max("chunks").alias("most"))


def by_type(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks of each file type."""
    rows = documents_with_counts(documents, chunks)
    return rows.groupBy("file_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count and percent of each value; null counts as a value."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(total).select(column, "n", percent(F.col("n"), F.col("total")).alias("percent"))


def key_coverage(entries: DataFrame) -> DataFrame:
    """How many entries have each metadata key, and in percent."""
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    keys = entries.select(F.explode(F.map_keys("metadata")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.crossJoin(total).select("key", "n", percent(F.col("n"), F.col("total")).alias("percent"))


def index_histogram(entries: DataFrame, most: int = 20) -> DataFrame:
    """Entries by chunk index (missing: -1), the lowest first."""
    return entries.groupBy(F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index")).agg(F.count(F.lit(1)).alias("n")).orderBy("chunk_index").limit(most)


def repeated_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeated_samples(entries: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The first ``most`` entries, by position, of each value that several entries have; ``nth`` counts them from 1."""
    w = Window.partitionBy(column).orderBy("pos", "entry_id")
    first = entries.filter(F.col(column).isNotNull()).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    return first.join(repeated_values(entries, column).select(column), column, "left_semi")


def distinct_chunks(entries: DataFrame, most: int = 10) -> DataFrame:
    """Documents with most distinct chunk ids."""
    return entries.filter("document_id is not null").groupBy("document_id").agg(F.count_distinct("chunk_id").alias("chunk_ids")).orderBy(F.desc("chunk_ids"), "document_id").limit(most)


def presence(entries: DataFrame, *keys: str) -> DataFrame:
    """One row: how many entries hold each metadata key at all."""
    return entries.agg(*[F.count_if(F.map_contains_key("metadata", k)).alias(f"has_{k}") for k in keys], F.count(F.lit(1)).alias("entries"))


def citation_coverage(entries: DataFrame) -> DataFrame:
    """PDF entries in all, with citation, with formatted citation, and unnamed."""
    pdf = entries.filter("source_type = 'pdf'")
    there = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) != "")
    return pdf.agg(F.count(F.lit(1)).alias("pdfs"), there("citation").alias("with_citation"), there("formatted_citation").alias("with_formatted"), F.count_if(F.col("title") == "Unnamed PDF").alias("unnamed"))


def progress(documents: DataFrame, chunks: DataFrame, done: DataFrame, target: float = 66.0, seconds: float = 3.0) -> DataFrame:
    """One row: processed, total, percent, remaining, needed for the target share, seconds to it."""
    row = chunks.agg(F.count(F.lit(1)).alias("total")).crossJoin(done.agg(F.count(F.lit(1)).alias("processed")))
    needed = F.greatest((F.lit(target / 100.0) * F.col("total")).cast("long") - F.col("processed"), F.lit(0))
    return row.select("processed", "total", percent(F.col("processed"), F.col("total")).alias("percent"), (F.col("total") - F.col("processed")).alias("remaining"), needed.alias("needed"), (needed * seconds).alias("eta_s"))


def progress_rollup(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by file type and document, with a total of each type and of all (level 0, 1, 3)."""
    rows = chunks.join(documents.select(F.col("id").alias("document_id"), "file_type"), "document_id")
    return rows.rollup("file_type", "document_id").agg(F.count(F.lit(1)).alias("chunks"), F.grouping_id().cast("int").alias("level"))


def file_inventory(entries: DataFrame) -> DataFrame:
    """Chunks and first and last entry of each file path."""
    return entries.filter("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry"))


def collection_counts(collections: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return collections.join(n, "id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def collection_documents(collections: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Each collection with its documents' titles, in order of id."""
    rows = links.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    lists = rows.groupBy(F.col("collection_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("document_id", "title"))).alias("d"))
    return collections.join(lists, "id").select("id", "name", F.array_join(F.transform("d", lambda x: F.coalesce(x["title"], F.lit("?"))), "; ").alias("titles"))


def document_collections(documents: DataFrame, links: DataFrame, collections: DataFrame) -> DataFrame:
    """Each document's collections (array<struct<id, name>>, in order of id; empty if it has none)."""
    rows = links.select("document_id", F.col("collection_id").alias("id")).distinct().join(collections.select("id", "name"), "id")
    lists = rows.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("c"))
    return documents.select("id").join(lists, "id", "left").select("id", F.coalesce("c", F.array().cast("array<struct<id:bigint,name:string>>")).alias("collections"))


def pages_cited(sources: DataFrame) -> DataFrame:
    """Per answer and PDF title: distinct pages in order, and the documents."""
    return sources.groupBy("answer_id", "title").agg(F.array_sort(F.collect_set("page_number")).alias("p"), F.array_sort(F.collect_set("doc_id")).alias("d")).select(
        "answer_id", "title", F.array_join(F.transform("p", lambda x: x.cast("string")), ", ").alias("pages"), F.array_join(F.transform("d", lambda x: x.cast("string")), ", ").alias("doc_ids")
    )


def crawl_stats(page_chunks: DataFrame) -> DataFrame:
    return page_chunks.groupBy("method").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("url").alias("pages"))
