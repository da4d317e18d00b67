"""Sources, filters, joins and dedup of the chunk store over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.functions import text as T
from weftbase.operators import embed, match, rebuild, store
from weftbase.plans.fixtures import CHUNKS_SQL, DOCS_SQL, ENTRIES_SQL, EVENTS_SQL, METADATA, chunks, documents, entries, events
from weftbase.plans.registry import query
from weftbase.sources import tables
from weftbase.sources.scratch import keep, scratch_path


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources and sinks


@query(f"WITH {ENTRIES_SQL} SELECT coalesce(source_type, 'none') AS source_type, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM entries GROUP BY 1")
def store_round_trip(spark, sf_dir):
    path = scratch_path(spark, "entries")
    rows = entries(spark, sf_dir).select("entry_id", "text", F.coalesce("source_type", F.lit("none")).alias("source_type"))
    tables.write_entries(rows, path, "overwrite")
    return tables.read_entries(spark, path).groupBy(F.col("source_type").cast("string").alias("source_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {EVENTS_SQL} SELECT error_type, count(*) AS n, cast(sum(ts) AS bigint) AS ts FROM ev GROUP BY 1")
def log_round_trip(spark, sf_dir):
    path = scratch_path(spark, "log")
    tables.append_log(events(spark, sf_dir).select("ts", "error_type"), path)
    return tables.read_log(spark, path, "ts long, error_type string").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts"))


@query(f"WITH {CHUNKS_SQL} SELECT id AS chunk_id FROM chunks")
def chunk_id_list(spark, sf_dir):
    path = scratch_path(spark, "ids")
    tables.write_chunk_ids(chunks(spark, sf_dir), path)
    return spark.read.schema("chunk_id long").json(path)


@query(f"WITH {DOCS_SQL}, t AS (SELECT id, unnest(list_filter(list_transform(string_split(source || ',' || lang || ', ' || cast(id % 10 AS varchar), ','), lambda x: trim(x)), lambda x: x <> '')) AS topic FROM docs) SELECT topic, count(*) AS n FROM t GROUP BY 1")
def topic_lists(spark, sf_dir):
    """Topics given as JSON, with commas or in lines, by document."""
    parts = [F.col("source"), F.col("lang"), (F.col("id") % 10).cast("string")]
    as_json = F.to_json(F.array(*parts))
    given = F.when(F.col("id") % 3 == 0, as_json).when(F.col("id") % 3 == 1, F.concat_ws(" , ", *parts)).otherwise(F.concat_ws("\n", *parts))
    rows = documents(spark, sf_dir).select(F.explode(T.topics(given)).alias("topic"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS_SQL} SELECT sha256(document_id || ':' || chunk_index) AS entry_id, document_id, chunk_index, filename, md5(text_content) AS text, 32 AS dim, CAST(NULL AS VARCHAR) AS error FROM chunks WHERE length(text_content) >= 10")
def rebuild_store(spark, sf_dir):
    """The whole job: chunks with their documents, embedded in waves, written."""
    rows = rebuild.rebuild(documents(spark, sf_dir).drop("text"), chunks(spark, sf_dir), scratch_path(spark, "rebuild"), "all", lambda: embed.hashing_embedder(32), 32, waves=4)
    return rows.select("entry_id", "document_id", "chunk_index", "filename", F.md5(F.col("text").cast("binary")).alias("text"), F.size("vector").alias("dim"), "error")


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS before, 0 AS after FROM entries")
def clear_store(spark, sf_dir):
    path = scratch_path(spark, "cleared")
    tables.write_table(entries(spark, sf_dir).select("entry_id", "pos"), path)
    before = spark.read.parquet(path).count()
    tables.clear_table(spark, path, "entry_id string, pos long")
    after = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("after"))
    return after.select(F.lit(before).cast("long").alias("before"), F.col("after").cast("int").alias("after"))


# Filters and projections


@query("SELECT doc_id, CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || '...' ELSE text END AS text FROM documents WHERE length(text) >= 10")
def ingest_guard(spark, sf_dir):
    return store.guarded(_raw(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, md5(substring(text, 1, 4000)) AS input, substring(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 5000) AS retry, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def embedding_inputs(spark, sf_dir):
    rows = _raw(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(store.embedding_input(F.col("text")).cast("binary")).alias("input"), T.collapsed(F.col("text")).alias("retry"), T.truncated(F.col("text"), 100).alias("preview"))


@query(f"WITH {DOCS_SQL} SELECT id FROM docs WHERE contains(lower(coalesce(title, '')), 'c1_') OR contains(lower(filename), 'c1_') OR contains(lower(coalesce(source_url, '')), 'c1_') OR contains(lower(coalesce(journal, '')), 'c1_') OR contains(lower(coalesce(doi, '')), 'c1_') OR contains(lower(coalesce(title, '')), 'study 12') OR contains(lower(coalesce(doi, '')), '.kb.12')")
def document_search(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = store.search_documents(docs, "C1_").select("id").union(store.search_documents(docs, "STUDY 12").select("id")).union(store.search_documents(docs, ".kb.12").select("id"))
    return found.distinct()


@query(f"WITH {DOCS_SQL} SELECT id, contains(source_url, '/disease/') AS topic FROM docs WHERE contains(source_url, 'www.src1')")
def url_filter(spark, sf_dir):
    return store.by_url(documents(spark, sf_dir), "www.src1", "source_url").select("id", store.is_topic_page(F.col("source_url")).alias("topic"))


@query(f"WITH {ENTRIES_SQL} SELECT entry_id FROM entries WHERE contains(filename, 'src3-') OR contains(file_path, 'src3-') OR contains(title, 'src3-') OR contains(citation, 'src3-')")
def filename_filter(spark, sf_dir):
    return store.by_filename(entries(spark, sf_dir), "src3-").select("entry_id")


@query(f"WITH {ENTRIES_SQL}, gone AS (SELECT * FROM entries WHERE document_id % 50 = 0), paths AS (SELECT DISTINCT file_path FROM gone WHERE file_path IS NOT NULL) SELECT entry_id FROM entries WHERE document_id % 50 <> 0 AND (file_path IS NULL OR file_path NOT IN (SELECT file_path FROM paths))")
def delete_documents(spark, sf_dir):
    removed = documents(spark, sf_dir).filter("id % 50 = 0").select("id")
    return store.without_documents(entries(spark, sf_dir), removed).select("entry_id")


@query(f"WITH {ENTRIES_SQL}, gone AS (SELECT * FROM entries WHERE document_id % 50 = 0), hit AS (SELECT document_id, CASE WHEN document_id % 50 = 0 THEN 'named' ELSE 'path' END AS cause FROM entries WHERE document_id % 50 = 0 OR file_path IN (SELECT file_path FROM gone WHERE file_path IS NOT NULL)) SELECT document_id, cause, count(*) AS n FROM hit GROUP BY ALL")
def removed_by_document(spark, sf_dir):
    """What the removal of ``delete_documents`` takes, of the named documents and of those that share their files."""
    rows = entries(spark, sf_dir)
    return store.removed_counts(rows, rows.filter("document_id % 50 = 0"), "document_id")


@query(f"WITH {ENTRIES_SQL}, gone AS (SELECT * FROM entries WHERE contains(url, '/disease/')), hit AS (SELECT source_type, CASE WHEN coalesce(contains(url, '/disease/'), false) THEN 'named' ELSE 'path' END AS cause FROM entries WHERE coalesce(contains(url, '/disease/'), false) OR file_path IN (SELECT file_path FROM gone WHERE file_path IS NOT NULL)) SELECT source_type, cause, count(*) AS n FROM hit GROUP BY ALL")
def removed_by_url(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return store.removed_counts(rows, rows.filter(F.contains("url", F.lit("/disease/"))), "source_type")


@query(f"WITH {ENTRIES_SQL}, named AS (SELECT *, coalesce(contains(filename, '_src1-1'), false) OR coalesce(contains(file_path, '_src1-1'), false) OR coalesce(contains(title, '_src1-1'), false) OR coalesce(contains(citation, '_src1-1'), false) AS hit FROM entries), gone AS (SELECT file_path FROM named WHERE hit AND file_path IS NOT NULL) SELECT filename, CASE WHEN hit THEN 'named' ELSE 'path' END AS cause, count(*) AS n FROM named WHERE hit OR file_path IN (SELECT file_path FROM gone) GROUP BY ALL")
def removed_by_filename(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return store.removed_counts(rows, store.by_filename(rows, "_src1-1"), "filename")


@query(f"WITH {DOCS_SQL}, s AS (SELECT id, unnest(string_split(regexp_extract(source_url, '^[a-z]+://[^/]+(.*)', 1), '/')) AS slug FROM docs WHERE contains(source_url, 'src2')) SELECT id, slug FROM s WHERE length(slug) > 5 AND contains(slug, '-')")
def url_slugs(spark, sf_dir):
    return store.slug_rows(documents(spark, sf_dir).filter("source_url is not null"), "source_url", host="src2").select("id", "slug")


@query(f"WITH {DOCS_SQL} SELECT id, title IS NULL OR lower(title) IN ('', 'untitled', 'unnamed pdf') AS untitled FROM docs WHERE file_type = 'pdf' AND (doi IS NULL OR formatted_citation IS NULL OR formatted_citation = '')")
def pending_citations(spark, sf_dir):
    rows = store.pending_citations(documents(spark, sf_dir))
    names = store.untitled(documents(spark, sf_dir)).select("id", F.lit(True).alias("untitled"))
    return rows.join(names, "id", "left").select("id", F.coalesce("untitled", F.lit(False)).alias("untitled"))


@query(f"WITH {DOCS_SQL}, files AS (SELECT id % 20 AS upload_id, id AS ord, CASE WHEN id % 9 = 0 THEN replace(filename, '.pdf', '.txt') WHEN id % 4 = 0 THEN 'new' || id || '.PDF' ELSE filename END AS filename, file_size * 20000 AS length FROM docs), known AS (SELECT DISTINCT lower(filename) AS name FROM docs WHERE id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY ord, filename) AS nth FROM files) SELECT ord, CASE WHEN nth > 50 THEN 'too many files' WHEN NOT lower(filename) LIKE '%.pdf' THEN 'type' WHEN length > 52428800 THEN 'size' WHEN lower(filename) IN (SELECT name FROM known) THEN 'duplicate' END AS skip_reason FROM r")
def upload_validation(spark, sf_dir):
    docs = documents(spark, sf_dir)
    name = F.when(F.col("id") % 9 == 0, F.regexp_replace("filename", r"\.pdf", ".txt")).when(F.col("id") % 4 == 0, F.concat(F.lit("new"), F.col("id").cast("string"), F.lit(".PDF"))).otherwise(F.col("filename"))
    files = docs.select((F.col("id") % 20).alias("upload_id"), F.col("id").alias("ord"), name.alias("filename"), (F.col("file_size") * 20000).alias("length"))
    return store.validated_uploads(files, docs.filter("id % 2 = 0").select("filename")).select("ord", "skip_reason")


@query(f"WITH {CHUNKS_SQL} SELECT id FROM chunks WHERE chunk_index < 3")
def capped_chunks(spark, sf_dir):
    return store.capped(chunks(spark, sf_dir), 3).select("id")


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, " + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in METADATA) + " AS fields FROM entries")
def metadata_maps(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", F.size(store.metadata_map(*METADATA)).cast("int").alias("fields"))


@query(f"WITH {ENTRIES_SQL} SELECT entry_id FROM entries WHERE NOT coalesce(contains(title, 'src4 '), false) AND NOT coalesce(contains(file_path, 'src4 '), false) AND NOT coalesce(contains(citation, 'src4 '), false) AND NOT coalesce(contains(title, 'de study 1'), false)")
def blocked_sources(spark, sf_dir):
    blocked = spark.createDataFrame([("src4 ",), ("de study 1",)], "term string")
    return store.without_blocked(entries(spark, sf_dir), blocked).select("entry_id")


# Joins and dedup


@query(f"WITH {ENTRIES_SQL} SELECT id FROM chunks WHERE id NOT IN (SELECT try_cast(chunk_id AS bigint) FROM entries WHERE try_cast(chunk_id AS bigint) IS NOT NULL)")
def unprocessed_chunks(spark, sf_dir):
    return store.unprocessed(chunks(spark, sf_dir), entries(spark, sf_dir)).select("id")


@query(f"WITH {ENTRIES_SQL}, k AS (SELECT entry_id, try_cast(chunk_id AS bigint) AS n FROM entries), c AS (SELECT id FROM chunks WHERE id % 4 <> 0) SELECT entry_id, n IS NOT NULL AND n IN (SELECT id FROM c) AS valid FROM k")
def orphan_entries(spark, sf_dir):
    valid, orphans = store.split_orphans(entries(spark, sf_dir), chunks(spark, sf_dir).filter("id % 4 <> 0"))
    return valid.select("entry_id", F.lit(True).alias("valid")).union(orphans.select("entry_id", F.lit(False).alias("valid")))


@query(f"WITH {ENTRIES_SQL}, e AS (SELECT * FROM entries WHERE document_id % 3 = 1), m AS (SELECT * FROM docs WHERE file_type = 'pdf' AND filename NOT IN (SELECT filename FROM e WHERE filename IS NOT NULL) AND (doi IS NULL OR doi NOT IN (SELECT doi FROM e WHERE doi IS NOT NULL))) SELECT 'doc-' || id AS entry_id, coalesce(title, filename) || coalesce('. ' || formatted_citation, '') AS text FROM m")
def missing_documents(spark, sf_dir):
    docs, some = documents(spark, sf_dir).drop("text"), entries(spark, sf_dir).filter("document_id % 3 = 1")
    return store.placeholders(store.missing_documents(docs, some)).select("entry_id", "text")


@query(f"WITH {CHUNKS_SQL} SELECT c.id, d.filename, d.file_type FROM chunks c JOIN docs d ON c.document_id = d.id WHERE d.processed")
def chunk_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).filter("processed").select(F.col("id").alias("document_id"), "filename", "file_type")
    return chunks(spark, sf_dir).join(docs, "document_id").select("id", "filename", "file_type")


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY 1")
def parents_with_counts(spark, sf_dir):
    """Counts of children first, then one left join: at scale on orders and their lines."""
    lines = _raw(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return _raw(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query(f"WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS nth FROM entries WHERE chunk_id IS NOT NULL) SELECT chunk_id, entry_id FROM r WHERE nth = 1")
def first_by_chunk(spark, sf_dir):
    return store.first_by_chunk(entries(spark, sf_dir)).select("chunk_id", "entry_id")


@query(
    f"WITH {ENTRIES_SQL}, f AS (SELECT *, 'db_' || document_id AS key, " + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in METADATA)
    + " AS fields FROM entries), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fields DESC, pos) AS nth FROM f WHERE source_type = 'pdf') SELECT entry_id FROM r WHERE nth = 1 UNION ALL SELECT entry_id FROM f WHERE source_type IS NULL OR source_type <> 'pdf'"
)
def richest_by_source(spark, sf_dir):
    return store.richest_by_source(entries(spark, sf_dir), F.size(store.metadata_map(*METADATA))).select("entry_id")


@query(f"WITH {ENTRIES_SQL} SELECT entry_id, coalesce(source_type, file_type, CASE WHEN contains(entry_id, 'pdf') OR document_title IS NOT NULL THEN 'pdf' WHEN coalesce(url, source_url) IS NOT NULL THEN 'website' ELSE 'unknown' END) AS source_type, coalesce(url, source_url) AS url FROM entries")
def normalized_metadata(spark, sf_dir):
    return store.normalized_metadata(entries(spark, sf_dir)).select("entry_id", "source_type", "url")


@query(f"WITH {DOCS_SQL}, have AS (SELECT id % 10 AS collection_id, id AS document_id FROM docs WHERE id % 4 = 0), new AS (SELECT DISTINCT id % 12 AS collection_id, id * 2 AS document_id FROM docs) SELECT * FROM have UNION ALL SELECT * FROM new WHERE collection_id < 10 AND document_id IN (SELECT id FROM docs) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.collection_id = new.collection_id AND h.document_id = new.document_id)")
def collection_links(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id")
    have = docs.filter("id % 4 = 0").select((F.col("id") % 10).alias("collection_id"), F.col("id").alias("document_id"))
    new = docs.select((F.col("id") % 12).alias("collection_id"), (F.col("id") * 2).alias("document_id"))
    return store.add_membership(have, new, spark.range(10), docs)


@query(f"WITH {CHUNKS_SQL} SELECT id FROM docs WHERE id IN (SELECT document_id FROM chunks WHERE chunk_index >= 2)")
def documents_with_chunks(spark, sf_dir):
    some = chunks(spark, sf_dir).filter("chunk_index >= 2").select(F.col("document_id").alias("id"))
    return documents(spark, sf_dir).select("id").join(some, "id", "left_semi")


# Matching

#: Some documents are named by source and topic, others carry a date and time: every rule has matches.
_FILENAME = "CASE WHEN id % 9 = 2 THEN concat(source, '_study-', cast(id % 50 as string), '.pdf') WHEN id % 9 = 4 THEN concat('20250327_101112_', filename) ELSE filename END"
_NAMED = f"named AS (SELECT * REPLACE ({_FILENAME} AS filename) FROM docs)"
_KEYWORDS = """kw AS (SELECT DISTINCT filename, list_distinct(list_filter(regexp_split_to_array(lower(stem), '[_ -]+'), lambda x: length(x) > 3)) AS w FROM d),
kt AS (SELECT DISTINCT title FROM entries WHERE title IS NOT NULL),
kp AS (SELECT filename, title FROM (SELECT filename, title, list_filter(w, lambda x: contains(lower(title), x)) AS hit FROM kw, kt WHERE len(w) >= 2) WHERE len(hit) >= 2)"""
_PAIRS = f"""{_NAMED}, d AS (SELECT id, filename, file_path, title, doi, file_type, formatted_citation, regexp_replace(filename, '\\.[A-Za-z0-9]+$', '') AS stem FROM named),
e AS (SELECT * FROM entries), {_KEYWORDS},
r AS (
 SELECT e.entry_id, d.id, 1 AS rule FROM d JOIN e ON d.file_path = e.file_path
 UNION ALL SELECT e.entry_id, d.id, 2 FROM d JOIN e ON d.filename = e.filename
 UNION ALL SELECT e.entry_id, d.id, 3 FROM (SELECT entry_id, title FROM e WHERE title LIKE 'About %') e JOIN d ON contains(e.title, d.filename)
 UNION ALL SELECT e.entry_id, d.id, 4 FROM (SELECT entry_id, title FROM e WHERE title LIKE 'About %') e JOIN d ON contains(e.title, d.stem)
 UNION ALL SELECT e.entry_id, d.id, 5 FROM d JOIN e ON d.doi = e.doi
 UNION ALL SELECT e.entry_id, d.id, 6 FROM d JOIN e ON d.title = e.title
 UNION ALL SELECT e.entry_id, d.id, 7 FROM d JOIN kp ON d.filename = kp.filename JOIN e ON e.title = kp.title),
best AS (SELECT entry_id, id, rule FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rule, id DESC) AS nth FROM r) WHERE nth = 1)"""


def _named(spark, sf_dir):
    return documents(spark, sf_dir).drop("text").withColumn("filename", F.expr(_FILENAME))


@query(f"WITH {ENTRIES_SQL}, {_PAIRS} SELECT entry_id, id, rule FROM best")
def citation_cascade(spark, sf_dir):
    return match.cascade(_named(spark, sf_dir), entries(spark, sf_dir).drop("text"))


@query(f"WITH {ENTRIES_SQL}, {_PAIRS}, m AS (SELECT b.entry_id, d.formatted_citation AS c, d.doi AS d, d.file_type AS t FROM best b JOIN d ON b.id = d.id JOIN e ON e.entry_id = b.entry_id WHERE coalesce(e.source_type, 'unknown') IN ('pdf', 'unknown')) SELECT e.entry_id, coalesce(m.c, e.citation) AS citation, coalesce(m.d, e.doi) AS doi, coalesce(m.t, e.source_type) AS source_type FROM e LEFT JOIN m ON e.entry_id = m.entry_id")
def citation_sync(spark, sf_dir):
    docs, rows = _named(spark, sf_dir), entries(spark, sf_dir).drop("text")
    return match.synced(rows, docs, match.cascade(docs, rows)).select("entry_id", "citation", "doi", "source_type")


@query(
    f"""WITH {ENTRIES_SQL}, c AS (SELECT id, doi, title, filename, formatted_citation FROM docs WHERE formatted_citation IS NOT NULL),
byd AS (SELECT lower(doi) AS k, arg_max(formatted_citation, id) AS c FROM c WHERE doi <> '' GROUP BY 1),
byt AS (SELECT lower(title) AS k, arg_max(formatted_citation, id) AS c FROM c WHERE title <> '' GROUP BY 1),
byf AS (SELECT lower(filename) AS k, arg_max(formatted_citation, id) AS c FROM c GROUP BY 1),
bys AS (SELECT regexp_replace(lower(filename), '\\.[a-z0-9]+$', '') AS k, arg_max(formatted_citation, id) AS c FROM c GROUP BY 1)
SELECT entry_id, coalesce(byd.c, byt.c, byf.c, bys.c, coalesce(e.title, e.filename, 'Untitled') || '. (PDF Document)') AS citation FROM entries e LEFT JOIN byd ON lower(e.doi) = byd.k LEFT JOIN byt ON lower(e.title) = byt.k LEFT JOIN byf ON lower(e.filename) = byf.k LEFT JOIN bys ON regexp_replace(lower(e.filename), '\\.[a-z0-9]+$', '') = bys.k
WHERE e.citation IS NULL OR trim(e.citation) = '' OR e.citation = 'Unnamed PDF'"""
)
def citation_second_pass(spark, sf_dir):
    return match.second_pass(entries(spark, sf_dir).drop("text"), documents(spark, sf_dir).drop("text"))


@query(
    f"""WITH {ENTRIES_SQL}, d AS (SELECT id, filename, file_path, doi, lower(regexp_replace(filename, '\\.[A-Za-z0-9]+$', '')) AS stem FROM docs),
f AS (SELECT DISTINCT filename FROM entries WHERE filename IS NOT NULL), fp AS (SELECT d.id, f.filename FROM d JOIN f ON contains(lower(f.filename), d.stem)),
t AS (SELECT DISTINCT title FROM entries WHERE title IS NOT NULL), tp AS (SELECT d.id, t.title FROM d JOIN t ON contains(lower(t.title), d.stem)),
r AS (SELECT id, entry_id, 1 AS rule FROM d JOIN entries e ON d.file_path = e.file_path UNION SELECT id, entry_id, 2 FROM d JOIN entries e ON d.filename = e.filename UNION SELECT id, entry_id, 3 FROM d JOIN entries e ON d.doi = e.doi UNION SELECT fp.id, e.entry_id, 4 FROM fp JOIN entries e ON e.filename = fp.filename UNION SELECT tp.id, e.entry_id, 4 FROM tp JOIN entries e ON e.title = tp.title)
SELECT id, entry_id, rule FROM r WHERE rule = (SELECT min(rule) FROM r q WHERE q.id = r.id)"""
)
def citation_rebuild(spark, sf_dir):
    docs = documents(spark, sf_dir).drop("text")
    return match.per_document(docs, entries(spark, sf_dir).drop("text")).select("id", "entry_id", "rule")


_FILENAME_PAIRS = f"""WITH {ENTRIES_SQL}, {_NAMED}, d AS (SELECT id, filename, regexp_replace(filename, '\\.[A-Za-z0-9]+$', '') AS stem FROM named), {_KEYWORDS},
b AS (SELECT DISTINCT filename, stem, regexp_replace(regexp_replace(stem, '^([0-9]{{14}}|[0-9]{{8}}_[0-9]{{6}})_', ''), '^[0-9]{{8}}_', '') AS bare FROM d),
f AS (SELECT DISTINCT filename AS held FROM entries WHERE filename IS NOT NULL),
p AS (SELECT filename, held, CASE WHEN filename = held THEN 1 WHEN contains(held, stem) THEN 2 WHEN contains(filename, held) THEN 3 ELSE 4 END AS rule FROM b, f WHERE contains(held, bare) OR contains(filename, held)),
r AS (SELECT d.id, e.entry_id, p.rule FROM p JOIN d ON d.filename = p.filename JOIN entries e ON e.filename = p.held UNION ALL SELECT d.id, e.entry_id, 5 FROM kp JOIN d ON d.filename = kp.filename JOIN entries e ON e.title = kp.title)
SELECT id, entry_id, min(rule) AS rule FROM r GROUP BY 1, 2"""


@query(_FILENAME_PAIRS)
def filename_matches(spark, sf_dir):
    write = lambda df: keep(df, "names", free=True)
    docs = write(_named(spark, sf_dir).select("id", "filename"))
    rows = write(entries(spark, sf_dir).select("entry_id", "filename", "title"))
    return match.filename_pairs(docs, rows, write).select("id", "entry_id", "rule")


@query(
    f"""WITH {ENTRIES_SQL}, {_NAMED}, pairs AS ({_FILENAME_PAIRS})
SELECT min(p.id) AS id, min(p.entry_id) AS entry_id, p.rule, count(DISTINCT p.id) AS n_documents, count(DISTINCT p.entry_id) AS n_entries FROM pairs p JOIN named d ON d.id = p.id JOIN entries e ON e.entry_id = p.entry_id GROUP BY d.filename, e.filename, e.title, p.rule"""
)
def filename_match_classes(spark, sf_dir):
    """The same matches between distinct names, with how many documents and entries have them."""
    docs, stored = _named(spark, sf_dir), entries(spark, sf_dir).drop("text")
    pairs = match.filename_classes(docs, stored)
    n_docs = match.classes(docs, "id", ("filename",)).select("id", F.col("members").alias("n_documents"))
    n_entries = match.classes(stored, "entry_id", ("filename", "title")).select("entry_id", F.col("members").alias("n_entries"))
    return pairs.join(n_docs, "id").join(n_entries, "entry_id").select("id", "entry_id", "rule", "n_documents", "n_entries")


@query(f"WITH {ENTRIES_SQL}, e AS (SELECT entry_id, substring(filename, 1, 12) AS title FROM entries WHERE file_path IS NULL AND filename IS NOT NULL), d AS (SELECT id, filename FROM docs WHERE file_path IS NOT NULL), t AS (SELECT title, max(d.id) AS id FROM (SELECT DISTINCT title FROM e) x JOIN d ON starts_with(d.filename, x.title) GROUP BY 1) SELECT entry_id, t.id FROM e JOIN t ON e.title = t.title WHERE length(e.title) >= 5")
def path_prefix_matches(spark, sf_dir):
    rows = entries(spark, sf_dir).filter("file_path is null").select("entry_id", "file_path", F.substring("filename", 1, 12).alias("title"))
    return match.path_prefix(documents(spark, sf_dir), keep(rows, "entries"))


@query(f"WITH {ENTRIES_SQL}, d AS (SELECT file_path, arg_max(doi, id) AS d, arg_max(formatted_citation, id) AS c FROM docs WHERE file_path IS NOT NULL GROUP BY 1) SELECT entry_id, coalesce(d.d, e.doi) AS doi, coalesce(d.c, e.citation) AS citation FROM entries e LEFT JOIN d ON e.file_path = d.file_path")
def fields_by_path(spark, sf_dir):
    return match.fields_by_path(entries(spark, sf_dir).drop("text"), documents(spark, sf_dir).drop("text")).select("entry_id", "doi", "citation")


@query(f"WITH {ENTRIES_SQL}, e AS (SELECT * FROM entries WHERE document_id % 6 = 1) SELECT id FROM docs WHERE file_path IN (SELECT file_path FROM e WHERE file_path IS NOT NULL) OR filename IN (SELECT filename FROM e WHERE filename IS NOT NULL) OR doi IN (SELECT doi FROM e WHERE doi IS NOT NULL)")
def present_documents(spark, sf_dir):
    return match.present_documents(documents(spark, sf_dir).drop("text"), entries(spark, sf_dir).filter("document_id % 6 = 1"))


@query(f"WITH {DOCS_SQL}, n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[a-z0-9]+$', ''), '^[0-9]{{14}}_', ''), '[_\\-\\s]+', '', 'g') AS name FROM docs) SELECT name, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def duplicate_filenames(spark, sf_dir):
    return match.duplicate_names(documents(spark, sf_dir))


_MARKS = ("study", "src1", "en")


@query(
    f"""WITH {DOCS_SQL}, {_NAMED}, n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[a-z0-9]+$', ''), '^[0-9]{{14}}_', ''), '[_\\-\\s]+', '', 'g') AS name FROM named), m AS (SELECT name, min(id) AS first FROM n GROUP BY 1),
l AS (SELECT a.name, min(b.first) AS first FROM m a, m b WHERE a.name = b.name OR length(a.name) > 5 AND contains(b.name, a.name) OR length(b.name) > 5 AND contains(a.name, b.name) OR {" + ".join(f"(contains(a.name, '{k}') AND contains(b.name, '{k}'))::int" for k in _MARKS)} >= 2 GROUP BY 1)
SELECT id, CASE WHEN l.first < id THEN l.first END AS duplicate_of FROM n JOIN l ON n.name = l.name"""
)
def duplicate_documents(spark, sf_dir):
    """Per document the first one before it that has a duplicate name."""
    return match.first_duplicates(_named(spark, sf_dir), _MARKS)


@query(f"WITH {CHUNKS_SQL} SELECT d.id, d.file_size, count(c.id) AS chunks FROM docs d LEFT JOIN chunks c ON c.document_id = d.id WHERE d.file_type = 'website' AND d.processed AND d.file_size > 0 GROUP BY 1, 2 HAVING d.file_size > count(c.id)")
def loadable_documents(spark, sf_dir):
    from weftbase.operators.queue import loadable

    return loadable(documents(spark, sf_dir).drop("text"), chunks(spark, sf_dir)).select("id", "file_size", "chunks")


# Sets


@query(f"WITH {ENTRIES_SQL} SELECT id FROM chunks EXCEPT SELECT try_cast(chunk_id AS bigint) FROM entries")
def pending_set(spark, sf_dir):
    return chunks(spark, sf_dir).select("id").subtract(store.processed_ids(entries(spark, sf_dir)))


@query(f"WITH {ENTRIES_SQL} SELECT try_cast(chunk_id AS bigint) AS chunk_id FROM entries WHERE try_cast(chunk_id AS bigint) IS NOT NULL UNION SELECT id FROM chunks WHERE id % 11 = 0")
def processed_union(spark, sf_dir):
    done = store.processed_ids(entries(spark, sf_dir))
    return done.union(chunks(spark, sf_dir).filter("id % 11 = 0").select("id")).distinct()


@query("WITH q AS (SELECT item_id, text FROM benchmark), d AS (SELECT doc_id, text FROM documents), j AS (SELECT doc_id, item_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS b FROM d JOIN q ON d.doc_id % 40 = q.item_id % 40) SELECT doc_id, item_id, len(list_intersect(a, b)) AS shared FROM j")
def token_overlap(spark, sf_dir):
    from weftbase.operators.search import words

    d = _raw(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), (F.col("doc_id") % 40).alias("k"))
    q = _raw(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"), (F.col("item_id") % 40).alias("k"))
    return d.join(q, "k").select("doc_id", "item_id", F.size(F.array_intersect(words(F.col("a")), words(F.col("b")))).cast("long").alias("shared"))


@query(f"WITH {ENTRIES_SQL}, kept AS (SELECT entry_id, pos FROM entries WHERE pos % 4 = 0), new AS (SELECT entry_id, pos + 1000000000 AS pos FROM entries WHERE pos % 6 = 0) SELECT entry_id, pos FROM new UNION ALL SELECT entry_id, pos FROM kept WHERE entry_id NOT IN (SELECT entry_id FROM new)")
def upserted_entries(spark, sf_dir):
    rows = entries(spark, sf_dir).select("entry_id", "pos")
    return store.upsert(rows.filter("pos % 4 = 0"), rows.filter("pos % 6 = 0").withColumn("pos", F.col("pos") + 1_000_000_000))


@query(f"WITH {ENTRIES_SQL}, m AS (SELECT document_id FROM entries GROUP BY 1 HAVING count(*) > 1) SELECT document_id, entry_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS nth FROM entries WHERE document_id IN (SELECT document_id FROM m) QUALIFY nth <= 10")
def repeated_id_samples(spark, sf_dir):
    """The first ten entries of each document that has several."""
    from weftbase.operators.profile import repeated_samples

    return repeated_samples(entries(spark, sf_dir).select("document_id", "entry_id", "pos"), "document_id").select("document_id", "entry_id", "nth")
