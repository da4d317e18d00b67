"""Statistics, search, queues, monitoring, pages, embedding and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftbase.operators import embed, monitor, pages, profile, queue, search, store
from weftbase.plans.fixtures import CHUNKS_SQL, DOCS_SQL, ENTRIES_SQL, EVENTS_SQL, METADATA, chunks, documents, entries, events
from weftbase.plans.registry import query
from weftbase.sources.scratch import keep, scratch_path
from weftbase.streaming import ingest, streams


def _raw(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Statistics


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS documents, count(*) FILTER (file_type = 'pdf') AS pdfs, count(*) FILTER (file_type = 'website') AS websites, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT source) FROM docs) AS collections FROM docs")
def corpus_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return profile.corpus_stats(docs, chunks(spark, sf_dir), docs.select("source").distinct())


@query(f"WITH {ENTRIES_SQL} SELECT count(DISTINCT CASE WHEN source_type = 'pdf' THEN title END) AS pdf_titles, count(DISTINCT CASE WHEN source_type = 'website' THEN nullif(regexp_extract(url, '^([a-z]+://[^/]+)', 1), '') END) AS origins, count(*) AS entries FROM entries")
def store_stats(spark, sf_dir):
    return profile.store_stats(entries(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT document_id, count(*) AS chunks FROM chunks GROUP BY 1 ORDER BY chunks DESC, document_id LIMIT 10")
def top_documents(spark, sf_dir):
    return profile.top_documents(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL}, c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT count(*) AS documents, round(avg(n), 6) AS average, max(n) AS most FROM c")
def chunk_average(spark, sf_dir):
    return profile.chunk_average(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT d.id, count(c.id) AS chunks FROM docs d LEFT JOIN chunks c ON c.document_id = d.id AND c.chunk_index > 0 GROUP BY 1")
def document_counts(spark, sf_dir):
    return profile.documents_with_counts(documents(spark, sf_dir).select("id"), chunks(spark, sf_dir).filter("chunk_index > 0"))


@query(f"WITH {CHUNKS_SQL}, n AS (SELECT d.id, d.file_type, count(c.id) AS n FROM docs d LEFT JOIN chunks c ON c.document_id = d.id GROUP BY 1, 2) SELECT file_type, count(*) AS documents, cast(sum(n) AS bigint) AS chunks FROM n GROUP BY 1")
def counts_by_type(spark, sf_dir):
    return profile.by_type(documents(spark, sf_dir).drop("text"), chunks(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT source_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM entries), 4) AS percent FROM entries GROUP BY 1")
def type_distribution(spark, sf_dir):
    return profile.distribution(entries(spark, sf_dir), "source_type")


@query(f"WITH {ENTRIES_SQL}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS key, count({c}) AS n FROM entries" for c in METADATA) + ") SELECT key, n, round(100.0 * n / (SELECT count(*) FROM entries), 4) AS percent FROM k WHERE n > 0")
def key_coverage(spark, sf_dir):
    return profile.key_coverage(entries(spark, sf_dir).select(store.metadata_map(*METADATA).alias("metadata")))


@query(f"WITH {ENTRIES_SQL} SELECT coalesce(chunk_index, -1) AS chunk_index, count(*) AS n FROM entries GROUP BY 1 ORDER BY 1 LIMIT 20")
def index_histogram(spark, sf_dir):
    return profile.index_histogram(entries(spark, sf_dir)).select(F.col("chunk_index").cast("long").alias("chunk_index"), "n")


@query(f"WITH {ENTRIES_SQL} SELECT chunk_id, count(*) AS n FROM entries WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_chunk_ids(spark, sf_dir):
    return profile.repeated_values(entries(spark, sf_dir), "chunk_id")


@query(f"WITH {ENTRIES_SQL} SELECT document_id, count(DISTINCT chunk_id) AS chunk_ids FROM entries WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def distinct_chunk_ids(spark, sf_dir):
    return profile.distinct_chunks(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT count(chunk_id) AS has_chunk_id, count(chunk_index) AS has_chunk_index, count(source_type) AS has_source_type, count(document_id) AS has_document_id, count(*) AS entries FROM entries")
def field_presence(spark, sf_dir):
    return profile.presence(entries(spark, sf_dir).select(store.metadata_map(*METADATA).alias("metadata")), "chunk_id", "chunk_index", "source_type", "document_id")


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS pdfs, count(*) FILTER (trim(citation) <> '') AS with_citation, count(*) FILTER (trim(formatted_citation) <> '') AS with_formatted, count(*) FILTER (title = 'Unnamed PDF') AS unnamed FROM entries WHERE source_type = 'pdf'")
def citation_coverage(spark, sf_dir):
    return profile.citation_coverage(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT DISTINCT try_cast(chunk_id AS bigint) AS chunk_id FROM entries WHERE try_cast(chunk_id AS bigint) IS NOT NULL")
def processed_ids(spark, sf_dir):
    return store.processed_ids(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, n AS (SELECT (SELECT count(*) FROM chunks) AS total, (SELECT count(DISTINCT try_cast(chunk_id AS bigint)) FROM entries) AS processed) SELECT processed, total, round(100.0 * processed / total, 4) AS percent, total - processed AS remaining, greatest(cast(floor(0.9 * total) AS bigint) - processed, 0) AS needed, 3.0::double * greatest(cast(floor(0.9 * total) AS bigint) - processed, 0) AS eta_s FROM n")
def load_progress(spark, sf_dir):
    return profile.progress(documents(spark, sf_dir), chunks(spark, sf_dir), store.processed_ids(entries(spark, sf_dir)), 90.0)


@query(f"WITH {CHUNKS_SQL} SELECT d.file_type, c.document_id, count(*) AS chunks, cast(grouping_id(d.file_type, c.document_id) AS int) AS level FROM chunks c JOIN docs d ON c.document_id = d.id GROUP BY ROLLUP (d.file_type, c.document_id)")
def progress_rollup(spark, sf_dir):
    return profile.progress_rollup(documents(spark, sf_dir), chunks(spark, sf_dir))


@query("SELECT o_orderpriority, o_custkey, count(*) AS orders, cast(grouping_id(o_orderpriority, o_custkey) AS int) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_custkey)")
def order_rollup(spark, sf_dir):
    """The progress rollup at scale: orders by priority and customer."""
    return _raw(spark, sf_dir, "orders").rollup("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.grouping_id().cast("int").alias("level"))


@query(f"WITH {ENTRIES_SQL} SELECT file_path, count(*) AS chunks, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM entries WHERE file_path IS NOT NULL GROUP BY 1")
def file_inventory(spark, sf_dir):
    return profile.file_inventory(entries(spark, sf_dir))


@query(f"WITH {DOCS_SQL}, l AS (SELECT id % 10 AS id, count(*) AS n, string_agg(coalesce(title, '?'), '; ' ORDER BY id) AS t FROM docs WHERE id % 3 = 0 GROUP BY 1), c AS (SELECT unnest(range(12)) AS id) SELECT c.id, coalesce(n, 0) AS documents, t AS titles FROM c LEFT JOIN l ON c.id = l.id")
def collections(spark, sf_dir):
    docs = documents(spark, sf_dir)
    all_ = spark.range(12).withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    links = docs.filter("id % 3 = 0").select((F.col("id") % 10).alias("collection_id"), F.col("id").alias("document_id"))
    counts = profile.collection_counts(all_, links).select("id", "documents")
    return counts.join(profile.collection_documents(all_, links, docs).select("id", "titles"), "id", "left")


@query(f"WITH {DOCS_SQL}, l AS (SELECT id AS document_id, id % 10 AS c FROM docs WHERE id % 3 = 0 UNION SELECT id, id % 7 FROM docs WHERE id % 2 = 0), n AS (SELECT document_id, string_agg('c' || c, '; ' ORDER BY c) AS names FROM l GROUP BY 1) SELECT id, coalesce(names, '') AS names FROM docs LEFT JOIN n ON id = document_id")
def document_collections(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id")
    all_ = spark.range(12).withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    link = lambda some, k: docs.filter(some).select((F.col("id") % k).alias("collection_id"), F.col("id").alias("document_id"))
    found = profile.document_collections(docs, link("id % 3 = 0", 10).union(link("id % 2 = 0", 7)), all_)
    return found.select("id", F.array_join(F.transform("collections", lambda c: c["name"]), "; ").alias("names"))


# Search. Queries are the vectors whose id is divisible by 50, with a benchmark text each.

_TYPES = "CASE WHEN label % 2 = 0 THEN 'pdf' ELSE 'website' END"


def _entries(spark, sf_dir):
    rows = _raw(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") % 2 == 0, "pdf").otherwise("website")
    url = F.when(F.col("label") % 2 == 1, F.concat(F.lit("https://x.org/"), F.when(F.col("vec_id") % 3 == 0, "disease/").otherwise("p/"), F.when(F.col("vec_id") % 2 == 0, "the-").otherwise("zz-"), F.col("label").cast("string")))
    text = F.concat(F.when(F.col("vec_id") % 7 == 0, "Header: ").otherwise(""), F.lit("the of "), F.when(F.col("vec_id") % 5 == 0, "and gout ").otherwise("x "), F.col("vec_id").cast("string"))
    return rows.select(F.col("vec_id").cast("string").alias("entry_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vector"), text.alias("text"), F.concat(F.lit("Title "), F.col("vec_id").cast("string")).alias("title"), url.alias("url"), kind.alias("source_type"), (F.col("vec_id") % 5).alias("page_number"))


def _queries(spark, sf_dir):
    rows = _raw(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    text = F.when(F.col("vec_id") % 100 == 0, "The and gouty thing").otherwise("of zebra")
    return rows.select(F.col("vec_id").alias("query_id"), text.alias("query"), F.col("embedding").cast("array<double>").alias("vector"))


_SEARCH = f"""q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 100 = 0 THEN ['the', 'and', 'gouty', 'thing'] ELSE ['of', 'zebra'] END AS words, CASE WHEN vec_id % 100 = 0 THEN 'the and gouty thing' ELSE 'of zebra' END AS query, embedding FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id, embedding, label, {_TYPES} AS source_type, (CASE WHEN vec_id % 7 = 0 THEN 'Header: ' ELSE '' END) || 'the of ' || (CASE WHEN vec_id % 5 = 0 THEN 'and gout ' ELSE 'x ' END) || vec_id AS text, vec_id % 5 AS page, CASE WHEN label % 2 = 1 THEN (CASE WHEN vec_id % 2 = 0 THEN 'the ' ELSE 'zz ' END) || label END AS topic FROM embeddings),
d AS (SELECT q.query_id, q.words, q.query, e.*, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::double - e.embedding[i]::double) * (q.embedding[i]::double - e.embedding[i]::double))) AS dist FROM q, e),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 25)"""


@query(f"WITH {_SEARCH} SELECT query_id, vec_id AS pos, rank, round(dist, 6) AS dist FROM p")
def vector_pool(spark, sf_dir):
    found = search.block_topk(_queries(spark, sf_dir), _entries(spark, sf_dir), 25)
    return found.select("query_id", "pos", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


_SCORED = f"""{_SEARCH},
f AS (SELECT *, len(list_intersect(words, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')))) AS shared, len(list_filter(words, lambda w: contains(lower(text), w))) > 0 AS inside, contains(text, 'gout') AS gout, source_type = 'website' AND vec_id % 3 = 0 AS on_topic FROM p),
s AS (SELECT *, greatest(dist - 0.15 * shared, 0) AS start,
 0.15 + (CASE WHEN vec_id % 7 = 0 THEN 0.12 ELSE 0 END) + (CASE WHEN on_topic THEN 0.25 + (CASE WHEN vec_id % 2 = 0 AND contains(query, 'the') OR contains(query, cast(label AS varchar)) THEN 0.35 ELSE 0 END) ELSE 0 END) + (CASE WHEN page > 1 THEN least(0.18, 0.06 * page) ELSE 0 END) + (CASE WHEN inside THEN 0.10 ELSE 0 END)
 + (CASE WHEN gout OR on_topic THEN least(0.30, 0.15 + (CASE WHEN gout THEN 0.03 ELSE 0 END) + (CASE WHEN on_topic THEN 0.10 ELSE 0 END)) ELSE 0 END) AS web FROM f),
sc AS (SELECT *, round(CASE WHEN source_type = 'website' THEN greatest(start - web, 0) ELSE start END, 9) AS score, vec_id % 7 = 0 AS nav FROM s)"""
_TERMS = {"vocabulary": ("gout",), "url_terms": ("/disease/",)}


def _scored(spark, sf_dir):
    pool = search.block_topk(_queries(spark, sf_dir), _entries(spark, sf_dir), 25)
    rows = _entries(spark, sf_dir).drop("vector", "pos")
    hits = pool.join(rows, "entry_id").join(_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return search.rerank(hits, **_TERMS).withColumn("score", F.round("score", 9))


@query(f"WITH {_SCORED} SELECT query_id, vec_id AS pos, round(score, 6) AS score FROM sc")
def hybrid_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "pos", F.round("score", 6).alias("score"))


_PLACED = f"""{_SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, rank) AS rn FROM sc),
b AS (SELECT query_id, max(CASE WHEN source_type = 'website' AND rn <= 5 THEN 1 ELSE 0 END) AS has, coalesce(min(CASE WHEN source_type = 'website' AND nav THEN rn END), min(CASE WHEN source_type = 'website' THEN rn END)) AS best FROM r GROUP BY 1),
o AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY CASE WHEN b.has = 0 AND rn = b.best THEN 0 ELSE 1 END, rn) AS place FROM r JOIN b ON r.query_id = b.query_id QUALIFY place <= 5),
t AS (SELECT query_id, max(CASE WHEN place = 1 THEN source_type END) AS a, max(CASE WHEN place = 2 THEN source_type END) AS c, max(CASE WHEN place = 3 THEN source_type END) AS e FROM o GROUP BY 1),
w AS (SELECT o.query_id, min(CASE WHEN t.a = t.c AND t.c = t.e AND place > 3 AND source_type <> t.a THEN place END) AS swap FROM o JOIN t ON o.query_id = t.query_id GROUP BY 1),
pl AS (SELECT o.* REPLACE (cast(CASE WHEN swap IS NULL THEN place WHEN place = 3 THEN swap WHEN place = swap THEN 3 ELSE place END AS int) AS place) FROM o JOIN w ON o.query_id = w.query_id)"""


@query(f"WITH {_PLACED} SELECT query_id, vec_id AS pos, place, round(score, 6) AS score FROM pl")
def hybrid_search(spark, sf_dir):
    """The flagship: batch hybrid search with placement."""
    return search.placed(_scored(spark, sf_dir), 5).select("query_id", "pos", "place", F.round("score", 6).alias("score"))


@query(f"WITH {_PLACED} SELECT query_id, source_type, count(*) AS n FROM pl GROUP BY 1, 2")
def hit_types(spark, sf_dir):
    return search.hit_types(search.placed(_scored(spark, sf_dir), 5))


@query(f"WITH {_PLACED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, rank) AS i FROM pl) SELECT query_id, string_agg(chr(10) || 'Document [' || i || ']:' || chr(10) || text || chr(10), '' ORDER BY i) AS context FROM c GROUP BY 1")
def answer_context(spark, sf_dir):
    return search.context(search.placed(_scored(spark, sf_dir), 5))


@query(f"WITH {_PLACED} SELECT query_id, 'Title ' || (vec_id % 10) AS title, array_to_string(list_sort(list(DISTINCT page)), ', ') AS pages, array_to_string(list_sort(list(DISTINCT vec_id)), ', ') AS doc_ids FROM pl GROUP BY 1, 2")
def pages_cited(spark, sf_dir):
    hits = search.placed(_scored(spark, sf_dir), 5)
    rows = hits.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("Title "), (F.col("pos") % 10).cast("string")).alias("title"), "page_number", F.col("pos").alias("doc_id"))
    return profile.pages_cited(rows).withColumnRenamed("answer_id", "query_id")


@query(f"WITH {_PLACED}, k AS (SELECT *, CASE WHEN source_type = 'pdf' THEN 'pdf:Title ' || (vec_id % 4) ELSE 'web:' || (vec_id % 3) || '#' || page END AS key FROM pl) SELECT query_id, key, min(place) AS place FROM k GROUP BY 1, 2")
def source_dedup(spark, sf_dir):
    from weftbase.functions.answers import source_key

    hits = search.placed(_scored(spark, sf_dir), 5)
    key = source_key(F.col("source_type"), F.concat(F.lit("Title "), (F.col("pos") % 4).cast("string")), (F.col("pos") % 3).cast("string"), F.col("page_number"), F.col("entry_id"))
    return hits.withColumn("key", key).groupBy("query_id", "key").agg(F.min("place").alias("place"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) AS norm2, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) AS first FROM embeddings")
def vector_norms(spark, sf_dir):
    v = search.normalized(F.col("embedding"))
    n2 = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _raw(spark, sf_dir, "embeddings").select("vec_id", F.round(n2, 6).alias("norm2"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


# Queues


@query(f"WITH {DOCS_SQL}, p AS (SELECT id, CASE WHEN processing_state IS NOT NULL THEN 0 ELSE 1 END AS class FROM docs WHERE NOT processed ORDER BY class, id LIMIT 5) SELECT id FROM p WHERE class = (SELECT min(class) FROM p)")
def next_work(spark, sf_dir):
    return queue.next_work(documents(spark, sf_dir).drop("text")).select("id")


@query(f"WITH {CHUNKS_SQL} SELECT id FROM chunks WHERE id > 5000 ORDER BY id LIMIT 5")
def keyset_page(spark, sf_dir):
    return queue.page_after(chunks(spark, sf_dir).select("id"), 5000, 5)


@query(f"WITH {CHUNKS_SQL}, p AS (SELECT * FROM docs ORDER BY created_s DESC, id LIMIT 10 OFFSET 20) SELECT p.id, (SELECT count(*) FROM chunks c WHERE c.document_id = p.id) AS chunks, cast(floor(((SELECT count(*) FROM docs) + 9) / 10) AS bigint) AS pages FROM p")
def document_listing(spark, sf_dir):
    return queue.listing(documents(spark, sf_dir).drop("text"), chunks(spark, sf_dir), 3, 10).select("id", "chunks", "pages")


@query(f"WITH {DOCS_SQL} SELECT id FROM docs ORDER BY created_s DESC, id DESC LIMIT 5")
def recent_documents(spark, sf_dir):
    return queue.recent(documents(spark, sf_dir)).select("id")


@query(f"WITH {CHUNKS_SQL} SELECT id, lead(id) OVER (ORDER BY document_id, chunk_index) AS next_id FROM chunks")
def next_chunk(spark, sf_dir):
    return queue.next_chunk(chunks(spark, sf_dir)).select("id", "next_id")


@query(f"WITH {CHUNKS_SQL} SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS ordinal FROM chunks")
def chunk_ordinals(spark, sf_dir):
    return queue.ordinals(chunks(spark, sf_dir)).select("id", "ordinal")


@query(f"WITH {CHUNKS_SQL} SELECT id FROM chunks WHERE chunk_index >= document_id % 4 AND chunk_index < document_id % 4 + 3")
def next_increment(spark, sf_dir):
    counts = documents(spark, sf_dir).select(F.col("id").alias("document_id"), (F.col("id") % 4).alias("loaded"))
    return queue.increment(chunks(spark, sf_dir), counts, 3).select("id")


@query(f"WITH {ENTRIES_SQL}, done AS (SELECT DISTINCT try_cast(chunk_id AS bigint) AS id FROM entries WHERE try_cast(chunk_id AS bigint) IS NOT NULL), n AS (SELECT greatest(cast(floor((SELECT count(*) FROM chunks) * 0.85) AS bigint) - (SELECT count(*) FROM done), 0) AS n) SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS nth FROM chunks WHERE id NOT IN (SELECT id FROM done)) WHERE nth <= (SELECT n FROM n)")
def until_target(spark, sf_dir):
    return queue.until_target(chunks(spark, sf_dir), store.processed_ids(entries(spark, sf_dir)), 85.0).select("id")


# Monitoring, on the event series


_RATES = f"{EVENTS_SQL}, l AS (SELECT *, chunks - lag(chunks) OVER w AS change, ts - lag(ts) OVER w AS seconds, first_value(ts) OVER w AS begun FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)), rt AS (SELECT *, round(CASE WHEN seconds > 0 THEN change / seconds END, 6) AS rate FROM l)"


@query(f"WITH {_RATES} SELECT event_id, change, seconds, rate, CASE WHEN rate > 0 THEN cast(floor((1000 - chunks) * seconds / change) AS bigint) END AS eta_s, CASE WHEN ts > begun THEN round(60.0 * chunks / (ts - begun), 6) END AS per_minute FROM rt")
def progress_rates(spark, sf_dir):
    return monitor.rates(events(spark, sf_dir), 1000).select("event_id", "change", "seconds", "rate", "eta_s", "per_minute")


@query(f"WITH {_RATES}, c AS (SELECT *, row_number() OVER w AS n, sum(is_error) OVER w AS errors FROM rt WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, n > 3 AND coalesce(rate, 0) < 0.1 AS low_rate, coalesce(change = 0, false) AS no_progress, errors > 5 AS many_errors FROM c")
def bottlenecks(spark, sf_dir):
    return monitor.bottlenecks(monitor.rates(events(spark, sf_dir), 1000)).select("event_id", "low_rate", "no_progress", "many_errors")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, e AS (SELECT run_id AS store_id, ts, event_id, chunks, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM ev),
r(store_id, n, ts, event_id, chunks, healthy, in_a_row, alert, held) AS (SELECT store_id, n, ts, event_id, chunks, true, 0, false, chunks FROM e WHERE n = 1
  UNION ALL SELECT store_id, n, ts, event_id, chunks, ok, k, k >= 3, CASE WHEN ok THEN chunks ELSE held END FROM (SELECT *, CASE WHEN ok THEN 0 WHEN alert THEN 1 ELSE in_a_row + 1 END AS k FROM (SELECT e.*, r.alert, r.in_a_row, r.held, e.chunks >= r.held::double * 0.9::double AS ok FROM r JOIN e ON e.store_id = r.store_id AND e.n = r.n + 1)))
SELECT store_id, ts, event_id, chunks, healthy, cast(in_a_row AS int) AS in_a_row, alert FROM r""")
def loss_alarm(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("run_id").alias("store_id"), "ts", "event_id", "chunks")
    return monitor.loss_alarm(rows)


@query(f"WITH {EVENTS_SQL}, s AS (SELECT event_id, list(mb) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS 14 PRECEDING) AS s FROM ev), t AS (SELECT event_id, CASE WHEN len(s) >= 7 THEN round(list_avg(s[len(s) // 2 + 1:]) - list_avg(s[1:len(s) // 2]), 6) END AS trend FROM s) SELECT event_id, trend, CASE WHEN trend IS NULL THEN 'unknown' WHEN trend > 20 THEN 'leak' WHEN trend > 10 THEN 'increasing' WHEN trend < -10 THEN 'decreasing' ELSE 'stable' END AS label FROM t")
def memory_trend(spark, sf_dir):
    return monitor.memory_trend(events(spark, sf_dir).withColumnRenamed("run_id", "host")).select("event_id", "trend", "label")


@query(f"WITH {EVENTS_SQL}, r AS (SELECT event_id, event_id % 101 AS c, event_id % 97 AS m FROM ev), f AS (SELECT *, cast(floor(least(1 - c::double / 100::double, 1 - m::double / 100::double) * 10::double) AS int) AS free FROM r) SELECT event_id, CASE WHEN c > 85 OR m > 85 THEN 1 ELSE greatest(1, least(10, free + 1)) END AS batch_size, CASE WHEN c > 85 OR m > 85 THEN 'single' WHEN free + 1 >= 6 THEN 'batch' ELSE 'careful' END AS mode FROM f")
def batch_modes(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("event_id") % 101).cast("double").alias("c"), (F.col("event_id") % 97).cast("double").alias("m"))
    return rows.select("event_id", monitor.batch_mode(F.col("c"), F.col("m")).alias("b")).select("event_id", "b.batch_size", "b.mode")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT event_id, event_id * 97 % 400000 AS s FROM ev) SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS took FROM s")
def durations(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", monitor.duration_text(F.col("event_id") * 97 % 400000).alias("took"))


@query(f"WITH {EVENTS_SQL} SELECT error_type, count(*) AS errors, count(*) FILTER (document_id IS NOT NULL AND recoverable) AS recoverable, count(*) FILTER (document_id IS NOT NULL AND NOT recoverable) AS unrecoverable FROM ev GROUP BY ROLLUP (error_type)")
def error_rollup(spark, sf_dir):
    return monitor.error_rollup(events(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT document_id, count(*) AS errors, bool_or(NOT recoverable) AS failed, NOT bool_or(NOT recoverable) AS retryable FROM ev WHERE document_id IS NOT NULL GROUP BY 1")
def document_errors(spark, sf_dir):
    return monitor.document_errors(events(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, r AS (SELECT event_id % 37 AS batch_id, event_id AS chunk_id, CASE WHEN is_error = 1 THEN 'failed' WHEN event_id % 6 = 0 THEN 'skipped' ELSE 'ok' END AS outcome, 0.5 AS seconds FROM ev) SELECT batch_id, count(*) AS total, count(*) FILTER (outcome = 'ok') AS successful, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, coalesce(string_agg(CASE WHEN outcome = 'failed' THEN cast(chunk_id AS varchar) END, ',' ORDER BY chunk_id), '') AS failed_ids, round(cast(count(*) FILTER (outcome = 'ok') AS double) / (0.5 * count(*)), 6) AS per_second FROM r GROUP BY 1")
def batch_outcomes(spark, sf_dir):
    outcome = F.when(F.col("is_error") == 1, "failed").when(F.col("event_id") % 6 == 0, "skipped").otherwise("ok")
    rows = events(spark, sf_dir).select((F.col("event_id") % 37).alias("batch_id"), F.col("event_id").alias("chunk_id"), outcome.alias("outcome"), F.lit(0.5).alias("seconds"))
    return monitor.batch_outcomes(rows)


# Pages


@query()
def page_content(spark, sf_dir):
    return pages.main_content(pages.parsed(_raw(spark, sf_dir, "pages")))


@query()
def page_chunks(spark, sf_dir):
    text = pages.passed(pages.main_content(pages.parsed(_raw(spark, sf_dir, "pages"))), store.is_topic_page(F.col("url")))
    return pages.page_chunks(text, "2025-03-27").select("page_id", "chunk_index", "text", "page_number", "citation")


_MENU = "(?s)<(?:nav|header|footer)[ >].*?</(?:nav|header|footer)>"
_HREFS = "'<a href=\"([^\"]*)\"', 1"


@query(
    f"""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS host, regexp_extract_all(array_to_string(regexp_extract_all(html, '{_MENU}'), ''), {_HREFS}) AS menu, regexp_extract_all(regexp_replace(html, '{_MENU}', '', 'g'), {_HREFS}) AS rest FROM pages),
h AS (SELECT url, host, unnest(list_transform(menu || rest, lambda x, i: {{'href': x, 'at': i, 'nav': i <= len(menu)}})) AS l FROM p),
f AS (SELECT url, host || l.href AS dst, min(l.at) AS place, arg_min(l.nav, l.at) AS nav FROM h WHERE starts_with(l.href, '/') GROUP BY ALL)
SELECT url, dst, nav, row_number() OVER (PARTITION BY url ORDER BY place) - 1 AS ord FROM f"""
)
def page_links(spark, sf_dir):
    return pages.links_of_urls(pages.parsed(_raw(spark, sf_dir, "pages")))


@query()
def crawl_stats(spark, sf_dir):
    text = pages.main_content(pages.parsed(_raw(spark, sf_dir, "pages")))
    return profile.crawl_stats(pages.page_chunks(text, "2025-03-27"))


@query()
def stored_crawl(spark, sf_dir):
    """From every page of each host's start: here every page is a seed of its own crawl of at most 25 pages."""
    parsed = keep(pages.parsed(_raw(spark, sf_dir, "pages")), "parsed")
    return pages.crawl(pages.links(parsed), parsed.select("url"), keywords=("topic",), keep=lambda df: keep(df, "crawl"))


@query(f"WITH {DOCS_SQL}, b AS (SELECT DISTINCT 'https://' || source || '.org/topic/' AS base FROM docs), t AS (SELECT DISTINCT lang || ' joint pain' AS term FROM docs), u AS (SELECT DISTINCT base, base || unnest([replace(term, ' ', '-'), replace(term, ' ', '')]) AS url FROM b, t) SELECT base, url FROM u")
def seed_urls(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bases = docs.select(F.concat(F.lit("https://"), "source", F.lit(".org/topic/")).alias("base"))
    return pages.seed_urls(bases, docs.select(F.concat("lang", F.lit(" joint pain")).alias("term"))).select("base", "url")


@query(f"WITH {CHUNKS_SQL}, l AS (SELECT document_id, chunk_index + 1 AS page_number, repeat(text_content, cast(1 + document_id % 9 AS bigint)) AS text FROM chunks WHERE chunk_index < 50), p AS (SELECT document_id, page_number, CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || '...' ELSE text END AS text FROM l), g AS (SELECT *, unnest(range(CASE WHEN length(text) <= 1500 THEN 1 ELSE 1 + cast(ceil((length(text) - 1500) / 1350.0) AS bigint) END)) AS k FROM p) SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number, k) - 1 AS ordinal, md5(substring(text, k * 1350 + 1, 1500)) AS text FROM g QUALIFY ordinal < 200")
def pdf_page_chunks(spark, sf_dir):
    """Pages of up to 13,500 characters."""
    rows = chunks(spark, sf_dir).select("document_id", (F.col("chunk_index") + 1).alias("page_number"), F.expr("repeat(text_content, cast(1 + document_id % 9 as int))").alias("text"))
    return pages.pdf_chunks(rows).select("document_id", "page_number", "ordinal", F.md5(F.col("text_content").cast("binary")).alias("text"))


# Embedding


@query()
def embedded_chunks(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("id", F.col("text_content").alias("text"))
    made = embed.embed_once(rows, lambda: embed.hashing_embedder(32), 32)
    return made.select("id", "vector", "error")


# Streams, over all events that are there


def _stream(spark, sf_dir):
    schema = _raw(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    rows = streams.read_stream(spark, f"{sf_dir}/event[s].parquet", schema)
    return rows.selectExpr("event_id", "user_id AS run_id", "cast(ts AS timestamp) AS ts", "cast(floor(value * 10) AS bigint) AS chunks", "event_type AS error_type", "event_id % 3 <> 0 AS recoverable", "CASE WHEN event_id % 4 <> 0 THEN user_id END AS document_id")


@query("SELECT user_id AS run_id, cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS begins, count(*) AS checks, max(cast(floor(value * 10) AS bigint)) - min(cast(floor(value * 10) AS bigint)) AS gain FROM events GROUP BY 1, 2")
def stream_rates(spark, sf_dir):
    return streams.drained(streams.interval_rates(_stream(spark, sf_dir), "1 hour")).withColumn("begins", F.unix_seconds("begins"))


@query("SELECT cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS begins, event_type AS error_type, count(*) AS errors, count(*) FILTER (event_id % 3 = 0) AS unrecoverable FROM events GROUP BY 1, 2")
def stream_errors(spark, sf_dir):
    return streams.drained(streams.error_rates(_stream(spark, sf_dir))).withColumn("begins", F.unix_seconds("begins"))


@query("SELECT user_id AS document_id, count(*) AS errors, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS failed, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) = 0 AS retryable FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def stream_status(spark, sf_dir):
    out = scratch_path(spark, "status")
    streams.merge_status(streams.document_status(_stream(spark, sf_dir)), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return streams.status(spark, out)


@query("SELECT user_id AS run_id, cast(w AS bigint) AS begins, count(*) AS checks, max(cast(floor(value * 10) AS bigint)) - min(cast(floor(value * 10) AS bigint)) AS gain FROM (SELECT *, unnest([floor(epoch(ts) / 600) * 600 - 3000, floor(epoch(ts) / 600) * 600 - 2400, floor(epoch(ts) / 600) * 600 - 1800, floor(epoch(ts) / 600) * 600 - 1200, floor(epoch(ts) / 600) * 600 - 600, floor(epoch(ts) / 600) * 600]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding_rates(spark, sf_dir):
    """Windows of an hour, a new one every ten minutes."""
    return streams.drained(streams.interval_rates(_stream(spark, sf_dir), "1 hour", "10 minutes")).withColumn("begins", F.unix_seconds("begins"))


@query("SELECT event_id AS chunk_id FROM events")
def stream_once(spark, sf_dir):
    """Every event comes again, ten minutes later, and counts once."""
    again = _stream(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    rows = _stream(spark, sf_dir).union(again).withColumnRenamed("event_id", "chunk_id")
    return streams.drained(streams.once_by_key(rows).select("chunk_id"), "append")


@query("WITH l AS (SELECT user_id AS run_id, cast(floor(epoch(ts)) AS bigint) AS ts FROM events), g AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts) AS next FROM l), m AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events) SELECT run_id, ts + 3600 AS ts, 'idle' AS state FROM g, m WHERE next - ts >= 3600 OR next IS NULL AND (ts + 3600) * 1000 <= mark UNION ALL SELECT run_id, next, 'working' FROM g WHERE next - ts >= 3600")
def stream_idle(spark, sf_dir):
    with streams.on_rocksdb(spark):
        return streams.drained(streams.idle_states(_stream(spark, sf_dir), 3600), "append")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id AS run_id, cast(floor(epoch(min(ts))) AS bigint) AS begins, count(*) AS events FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return streams.drained(streams.work_sessions(_stream(spark, sf_dir), "1 hour")).withColumn("begins", F.unix_seconds("begins"))


@query("WITH g AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1500 THEN 1 ELSE 1 + cast(ceil((length(text) - 1500) / 1350.0) AS bigint) END)) AS k FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, k, substring(text, k * 1350 + 1, 1500) AS t FROM g) SELECT doc_id * 1000000 + k AS chunk_id, doc_id AS document_id, cast(k AS int) AS chunk_index, md5(t) AS text, 32 AS dim FROM c WHERE length(t) >= 10")
def stream_ingest(spark, sf_dir):
    """Documents chunked, embedded and stored as they come; a second stream over them adds nothing."""
    out = scratch_path(spark, "ingested")
    schema = _raw(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    for name in ("first", "second"):
        rows = streams.read_stream(spark, f"{sf_dir}/document[s].parquet", schema).withColumnRenamed("doc_id", "id")
        work = lambda b: ingest.chunked(b, lambda: embed.hashing_embedder(32), 32)
        ingest.ingest(rows, work, out, scratch_path(spark, "checkpoint"), name).awaitTermination()
    return ingest.stored(spark, out).select("chunk_id", "document_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text"), F.size("vector").alias("dim"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS host, event_id, cast(floor(epoch(ts)) AS bigint) AS ts, floor(value * 10) / 10 AS mb FROM events),
s AS (SELECT *, list(mb) OVER w AS s, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS n FROM e WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS 14 PRECEDING)),
t AS (SELECT *, CASE WHEN len(s) >= 7 THEN round(list_avg(s[len(s) // 2 + 1:]) - list_avg(s[1:len(s) // 2]), 6) END AS trend FROM s),
r(host, n, event_id, ts, trend, act, acted) AS (SELECT host, n, event_id, ts, trend, coalesce(trend > 10, false), CASE WHEN trend > 10 THEN ts END FROM t WHERE n = 1
  UNION ALL SELECT t.host, t.n, t.event_id, t.ts, t.trend, coalesce(t.trend > 10, false) AND (acted IS NULL OR t.ts - acted >= 300), CASE WHEN coalesce(t.trend > 10, false) AND (acted IS NULL OR t.ts - acted >= 300) THEN t.ts ELSE acted END FROM r JOIN t ON t.host = r.host AND t.n = r.n + 1)
SELECT host, event_id, ts, trend, act FROM r""")
def stream_memory(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.col("run_id").alias("host"), "ts", "event_id", (F.col("chunks") / 10).alias("mb"))
    with streams.on_rocksdb(spark):
        return streams.drained(streams.memory_trends(rows), "append")


@query("""WITH RECURSIVE e AS (SELECT user_id AS store_id, cast(floor(epoch(ts)) AS bigint) AS ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(store_id, n, ts, k) AS (SELECT store_id, n, ts, CASE WHEN bad THEN 1 ELSE 0 END FROM e WHERE n = 1 UNION ALL SELECT e.store_id, e.n, e.ts, CASE WHEN NOT bad THEN 0 WHEN k >= 2 THEN 1 ELSE k + 1 END FROM r JOIN e ON e.store_id = r.store_id AND e.n = r.n + 1)
SELECT store_id, ts FROM r WHERE k >= 2""")
def stream_alarms(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.col("run_id").alias("store_id"), F.unix_seconds("ts").alias("ts"), (F.col("error_type") != "error").alias("ok"))
    return streams.drained(streams.failure_alarms(rows, 2), "append")
