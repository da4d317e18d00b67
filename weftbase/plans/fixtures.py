"""The knowledge base's tables as the driver's tables give them: expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.functions.text import fixed_chunks

DOCUMENT = {
    "id": "doc_id",
    "lang": "lang",
    "source": "source",
    "text": "text",
    "file_type": "CASE WHEN doc_id % 3 = 0 THEN 'website' ELSE 'pdf' END",
    "filename": "concat(CASE WHEN doc_id % 6 = 1 THEN '20250327145551_' ELSE '' END, lang, '_', source, '-', cast(doc_id % 400 as string), '.pdf')",
    "file_size": "n_chars",
    "created_s": "1700000000 + doc_id * 60",
    "processed": "doc_id % 5 <> 0",
    "processing_state": "CASE WHEN doc_id % 10 = 0 THEN concat('{\"total_chunks\": ', cast(doc_id % 90 + 10 as string), ', \"processed_chunks\": ', cast(doc_id % 7 as string), ', \"status\": \"processing\"}') WHEN doc_id % 15 = 5 THEN 'broken' END",
    "doi": "CASE WHEN doc_id % 4 = 0 THEN concat('10.1000/kb.', cast(doc_id % 300 as string)) END",
    "authors": "CASE WHEN doc_id % 2 = 0 THEN concat('Smith, J; Doe, ', upper(lang)) END",
    "journal": "CASE WHEN doc_id % 4 < 2 THEN concat('Journal of ', source) END",
    "publication_year": "CASE WHEN doc_id % 5 <> 1 THEN 1990 + doc_id % 35 END",
    "volume": "CASE WHEN doc_id % 3 = 1 THEN cast(doc_id % 40 as string) END",
    "issue": "CASE WHEN doc_id % 6 = 1 THEN cast(doc_id % 12 as string) END",
    "pages": "CASE WHEN doc_id % 4 = 1 THEN concat(cast(doc_id % 90 as string), '-', cast(doc_id % 90 + 9 as string)) END",
    "formatted_citation": "CASE WHEN doc_id % 8 = 0 THEN concat('Cited ', cast(doc_id as string)) WHEN doc_id % 8 = 1 THEN '' END",
}
MORE = {
    "title": "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'Unnamed PDF' WHEN id % 7 = 0 THEN concat('About ', filename) ELSE concat(source, ' ', lang, ' study ', cast(id as string)) END",
    "source_url": "CASE WHEN file_type = 'website' THEN concat('https://www.', source, '.example.org/', CASE WHEN id % 2 = 0 THEN 'disease/' ELSE 'pages/' END, 'joint-pain-', cast(id % 50 as string)) END",
    "file_path": "CASE WHEN file_type = 'pdf' THEN concat('uploads/', filename) END",
}
CHUNK = {"id": "document_id * 1000 + chunk_index", "page_number": "cast(floor(chunk_index / 3) as bigint) + 1"}
ENTRY = {
    "entry_id": "concat(CASE WHEN chunk_no % 2 = 0 THEN 'pdf-' ELSE 'e-' END, cast(chunk_no as string))",
    "pos": "chunk_no * 2",
    "text": "text_content",
    "chunk_id": "CASE WHEN chunk_no % 17 = 0 THEN 'x' WHEN chunk_no % 19 = 0 THEN NULL ELSE cast(chunk_no as string) END",
    "document_id": "document_id",
    "chunk_index": "CASE WHEN chunk_no % 37 <> 0 THEN chunk_index END",
    "source_type": "CASE WHEN chunk_no % 7 <> 0 THEN file_type END",
    "file_type": "CASE WHEN chunk_no % 3 = 0 THEN file_type END",
    "filename": "CASE WHEN chunk_no % 23 <> 0 THEN filename END",
    "file_path": "CASE WHEN chunk_no % 4 <> 0 THEN file_path END",
    "title": "title",
    "document_title": "CASE WHEN chunk_no % 29 = 0 THEN title END",
    "doi": "CASE WHEN chunk_no % 3 = 0 THEN doi END",
    "citation": "CASE WHEN chunk_no % 9 = 0 THEN 'Old citation' WHEN chunk_no % 9 = 1 THEN '' END",
    "formatted_citation": "formatted_citation",
    "url": "CASE WHEN chunk_no % 2 = 0 THEN source_url END",
    "source_url": "source_url",
    "page_number": "page_number",
}
METADATA = ("chunk_id", "document_id", "chunk_index", "source_type", "file_type", "filename", "file_path", "title", "doi", "citation", "url", "page_number")
AGAIN = "SELECT * REPLACE (concat('dup-', entry_id) AS entry_id, pos + 1 AS pos) FROM entries0 WHERE pos % 62 = 0"


def _list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


DOCS_SQL = f"docs0 AS (SELECT {_list(DOCUMENT)} FROM documents), docs AS (SELECT *, {_list(MORE)} FROM docs0)"
CHUNKS_SQL = (
    DOCS_SQL
    + ", grid AS (SELECT *, unnest(range(CASE WHEN length(text) = 0 OR text IS NULL THEN 0 WHEN length(text) <= 1500 THEN 1 ELSE 1 + cast(ceil((length(text) - 1500) / 1350.0) AS bigint) END)) AS chunk_index FROM docs)"
    + f", chunks0 AS (SELECT * RENAME (id AS document_id), substring(text, chunk_index * 1350 + 1, 1500) AS text_content FROM grid), chunks AS (SELECT *, {_list(CHUNK)} FROM chunks0)"
)
ENTRIES_SQL = CHUNKS_SQL + f", chunk_rows AS (SELECT * RENAME (id AS chunk_no) FROM chunks WHERE id % 5 <> 0), entries0 AS (SELECT {_list(ENTRY)} FROM chunk_rows), entries AS (SELECT * FROM entries0 UNION ALL {AGAIN})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[f"{e} AS {n}" for n, e in DOCUMENT.items()])
    return rows.selectExpr("*", *[f"{e} AS {n}" for n, e in MORE.items()])


def wide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document's columns: one pass over the texts."""
    rows = documents(spark, sf_dir).withColumn("c", F.explode(fixed_chunks(F.col("text")))).withColumnRenamed("id", "document_id")
    rows = rows.withColumns({"chunk_index": F.col("c.pos").cast("long"), "text_content": F.col("c.text")}).drop("c", "text")
    return rows.selectExpr("*", *[f"{e} AS {n}" for n, e in CHUNK.items()])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_chunks(spark, sf_dir).select("id", "document_id", "chunk_index", "page_number", "text_content")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as typed columns; every so often one is stored twice."""
    rows = wide_chunks(spark, sf_dir).filter("id % 5 <> 0").withColumnRenamed("id", "chunk_no").selectExpr(*[f"{e} AS {n}" for n, e in ENTRY.items()])
    again = rows.filter("pos % 62 = 0").withColumns({"entry_id": F.concat(F.lit("dup-"), "entry_id"), "pos": F.col("pos") + 1})
    return rows.unionByName(again)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, error and resource series: run_id, ts (seconds), event_id, chunks, mb, is_error, ..."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in EVENT_SPARK.items()])


EVENT_SHARED = {
    "event_id": "event_id",
    "run_id": "user_id",
    "chunks": "cast(floor(value * 10) as bigint)",
    "mb": "round(value, 3)",
    "is_error": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "error_type": "event_type",
    "document_id": "CASE WHEN event_id % 4 <> 0 THEN user_id END",
    "recoverable": "event_id % 3 <> 0",
}
EVENT_SPARK = EVENT_SHARED | {"ts": "unix_seconds(cast(ts as timestamp))", "at": "cast(ts as timestamp)"}
EVENTS_SQL = f"ev AS (SELECT {_list(EVENT_SHARED)}, cast(floor(epoch(ts)) AS bigint) AS ts FROM events)"
