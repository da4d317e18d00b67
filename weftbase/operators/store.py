"""The chunk store: guards, filters, deletion, orphans, missing rows, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftbase.functions.text import blank_to_null, truncated, url_slugs
from weftbase.operators.match import contained_values

TOPIC_PATTERNS = ("/topic/", "/disease/", "/diseases/", "/condition/", "/conditions/")


def guarded(entries: DataFrame, least: int = 10, most: int = 10_000) -> DataFrame:
    """Entries whose text is long enough, with very long ones cut."""
    return entries.filter(F.length("text") >= least).withColumn("text", truncated(F.col("text"), most))


def embedding_input(text: Column, most: int = 4_000) -> Column:
    return F.substring(text, 1, most)


def like_pattern(term: str) -> str:
    return "%" + term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"


def search_documents(documents: DataFrame, term: str, columns: tuple[str, ...] = ("title", "filename", "source_url", "journal", "doi")) -> DataFrame:
    """Documents with ``term`` in any of the columns, in either case; % and _ in it mean themselves."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(like_pattern(term)), F.lit(False))
    return documents.filter(hit)


def by_url(rows: DataFrame, pattern: str, column: str = "url", least: int = 5) -> DataFrame:
    if len(pattern) < least:
        raise ValueError(f"a URL pattern needs {least} characters")
    return rows.filter(F.contains(F.col(column), F.lit(pattern)))


def by_filename(rows: DataFrame, name: str, columns: tuple[str, ...] = ("filename", "file_path", "title", "citation")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(name)), F.lit(False))
    return rows.filter(hit)


def without_documents(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries but those of the removed documents (id), and those that share a file_path with such an entry."""
    gone = entries.join(removed.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    paths = gone.filter("file_path is not null").select("file_path").distinct()
    return entries.join(gone.select("entry_id"), "entry_id", "left_anti").join(paths, "file_path", "left_anti")


def removal(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The entries that go with ``gone`` (entry_id, file_path: those named for removal, by whatever rule), with
    ``cause``: named, or path where an entry only shares its file_path with a named one. An entry_id that is null
    names nothing, nor does a null path; repeated rows of ``gone`` count once."""
    named = gone.select("entry_id").filter("entry_id is not null").distinct()
    paths = gone.select("file_path").filter("file_path is not null").distinct()
    first = entries.join(named, "entry_id", "left_semi").withColumn("cause", F.lit("named"))
    swept = entries.join(named, "entry_id", "left_anti").join(paths, "file_path", "left_semi")
    return first.unionByName(swept.withColumn("cause", F.lit("path")))


def removed_counts(entries: DataFrame, gone: DataFrame, *by: str) -> DataFrame:
    """How many entries a removal takes by cause, and by the columns ``by``: cause, n. Nothing removed, no rows."""
    return removal(entries, gone).groupBy(*by, "cause").agg(F.count(F.lit(1)).alias("n"))


def slug_rows(rows: DataFrame, column: str, least: int = 5, host: str | None = None) -> DataFrame:
    """One row per slug of a URL, of one host only if it is given."""
    if host:
        rows = rows.filter(F.contains(F.col(column), F.lit(host)))
    return rows.withColumn("slug", F.explode(url_slugs(F.col(column), least)))


def is_topic_page(url: Column, patterns: tuple[str, ...] = TOPIC_PATTERNS) -> Column:
    return F.coalesce(url.rlike("^[a-zA-Z]+://[^/]+.*(" + "|".join(patterns) + ")"), F.lit(False))


def pending_citations(documents: DataFrame) -> DataFrame:
    """PDFs without a DOI or without a formatted citation (null or blank)."""
    return documents.filter((F.col("file_type") == "pdf") & (blank_to_null(F.col("doi")).isNull() | blank_to_null(F.col("formatted_citation")).isNull()))


def untitled(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("title").isNull() | F.lower("title").isin("", "untitled", "unnamed pdf"))


def validated_uploads(files: DataFrame, existing: DataFrame, most_bytes: int = 50 * 1024 * 1024, most_files: int = 50) -> DataFrame:
    """``files`` (upload_id, ord, filename, length) with skip_reason: null for those to take. The limit on
    files counts within an upload."""
    known = existing.select(F.lower("filename").alias("name")).distinct().withColumn("known", F.lit(True))
    at = F.row_number().over(Window.partitionBy("upload_id").orderBy("ord", "filename"))
    rows = files.withColumn("at", at).withColumn("name", F.lower("filename")).join(known, "name", "left")
    reason = (
        F.when(F.col("at") > most_files, "too many files").when(~F.endswith("name", F.lit(".pdf")), "type").when(F.col("length") > most_bytes, "size").when(F.col("known"), "duplicate")
    )
    return rows.withColumn("skip_reason", reason).drop("at", "name", "known")


def capped(chunks: DataFrame, most: int, by: str = "document_id", order: tuple[str, ...] = ("chunk_index",)) -> DataFrame:
    """The first ``most`` chunks of each document."""
    return chunks.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_at") <= most).drop("_at")


def metadata_map(*columns: str) -> Column:
    """A metadata map from columns: absent where null."""
    made = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def without_blocked(rows: DataFrame, blocked: DataFrame, columns: tuple[str, ...] = ("title", "file_path", "citation")) -> DataFrame:
    """Rows in none of whose columns a ``term`` of the block list occurs. Terms find the distinct values they occur
    in by equality joins on grams; rows with such a value go."""
    terms = blocked.select(F.col("term").alias("_n"))
    for c in columns:
        hit = contained_values(terms, rows.select(F.col(c).alias("_t"))).select(F.col("_t").alias(c)).distinct()
        rows = rows.join(hit, c, "left_anti").select(*rows.columns)
    return rows


def unprocessed(chunks: DataFrame, entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks whose id no entry has. Ids that are no numbers count for nothing."""
    done = processed_ids(entries)
    left = chunks.join(done, chunks["id"] == done["chunk_id"], "left_anti")
    return left.orderBy("id").limit(limit) if limit else left


def processed_ids(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("chunk_id").try_cast("bigint").alias("chunk_id")).filter("chunk_id is not null").distinct()


def split_orphans(entries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, orphans): entries whose chunk is in the table, and the rest."""
    ids = chunks.select(F.col("id").alias("chunk_no"))
    keyed = entries.withColumn("chunk_no", F.col("chunk_id").try_cast("bigint"))
    return keyed.join(ids, "chunk_no", "left_semi").drop("chunk_no"), keyed.join(ids, "chunk_no", "left_anti").drop("chunk_no")


def missing_documents(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """PDFs that no entry has by filename nor by DOI."""
    names = entries.filter("filename is not null").select("filename").distinct()
    dois = entries.filter("doi is not null").select("doi").distinct()
    return documents.filter("file_type = 'pdf'").join(names, "filename", "left_anti").join(dois, "doi", "left_anti")


def placeholders(documents: DataFrame) -> DataFrame:
    """Entries that stand for documents without any: their title and citation as text."""
    text = F.concat_ws(". ", F.coalesce("title", "filename"), "formatted_citation")
    return documents.select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("entry_id"), text.alias("text"), F.col("id").alias("document_id"), "filename", "file_path", "title", "doi", F.lit("pdf").alias("source_type"))


def first_by_chunk(entries: DataFrame) -> DataFrame:
    """One entry per chunk id, the first by position; entries without a chunk id go. An aggregate with partial
    results: an id that very many entries have is a row a task."""
    best = entries.filter("chunk_id is not null").groupBy("chunk_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in entries.columns]), "pos").alias("_first"))
    return best.select("_first.*")


def source_key(grain: str = "document") -> Column:
    """What an entry comes from: the first of document (or chunk) id, DOI, filename, path, hash of the text."""
    first = F.col("document_id") if grain == "document" else F.col("chunk_id")
    return F.coalesce(
        F.concat(F.lit("db_"), first.cast("string")), F.concat(F.lit("doi_"), F.col("doi")), F.concat(F.lit("file_"), F.col("filename")), F.concat(F.lit("path_"), F.col("file_path")), F.concat(F.lit("hash_"), F.md5(F.col("text").cast("binary")))
    )


def richest_by_source(entries: DataFrame, fields: Column, grain: str = "document", keep_other_types: bool = True) -> DataFrame:
    """Of each PDF source the entry with most metadata fields, then the first by position. An aggregate with
    partial results, so a source with very many entries is no hot spot."""
    rows = entries.withColumn("_key", source_key(grain)).withColumn("_fields", fields)
    best = rows.filter("source_type = 'pdf'").groupBy("_key").agg(F.max_by("entry_id", F.struct("_fields", -F.col("pos"))).alias("entry_id"))
    kept = rows.join(best.select("entry_id"), "entry_id", "left_semi")
    if keep_other_types:
        kept = kept.unionByName(rows.filter("source_type is null or source_type != 'pdf'"))
    return kept.drop("_key", "_fields")


def normalized_metadata(entries: DataFrame) -> DataFrame:
    """source_type and url under one name each: what writers called them, else inferred from the entry."""
    kind = F.when((F.col("file_type") == "pdf") | F.contains("entry_id", F.lit("pdf")) | F.col("document_title").isNotNull(), "pdf").when(F.coalesce("url", "source_url").isNotNull(), "website").otherwise("unknown")
    return entries.withColumns({"source_type": F.coalesce(blank_to_null(F.col("source_type")), blank_to_null(F.col("file_type")), kind), "url": F.coalesce(blank_to_null(F.col("url")), blank_to_null(F.col("source_url")))})


def add_membership(links: DataFrame, new: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Collection links with new ones added once; links to unknown collections or documents are refused."""
    fit = new.select("collection_id", "document_id").distinct()
    fit = fit.join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    fit = fit.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return links.unionByName(fit.join(links, ["collection_id", "document_id"], "left_anti"))


def rebuilt_entries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk store anew: every chunk with its document's metadata, guarded. Keys repeat from run to run."""
    rows = chunks.join(documents.withColumnRenamed("id", "document_id"), "document_id")
    rows = rows.withColumn("entry_id", F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256)).withColumnRenamed("text_content", "text")
    return guarded(rows)


def upsert(store: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
