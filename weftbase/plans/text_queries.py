"""Text, DOI, citation and answer functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftbase.functions import answers as A
from weftbase.functions import citation as C
from weftbase.functions import doi as D
from weftbase.functions import text as T
from weftbase.operators.queue import processing_state, state_percent
from weftbase.plans.fixtures import CHUNKS_SQL, DOCS_SQL, documents, wide_chunks
from weftbase.plans.registry import query
from weftbase.sources import tables
from weftbase.sources.scratch import scratch_path

WS = "[ \\t\\n\\x0B\\f\\r]+"


def _raw(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"WITH {CHUNKS_SQL} SELECT id, document_id, chunk_index, md5(text_content) AS text FROM chunks")
def fixed_chunks(spark, sf_dir):
    return wide_chunks(spark, sf_dir).select("id", "document_id", "chunk_index", F.md5(F.col("text_content").cast("binary")).alias("text"))


@query(
    """WITH g AS (SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + cast(ceil((length(text) - 1000) / 800.0) AS bigint) END)) AS pos FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, pos, n, substring(text, pos * 800 + 1, 1000) AS w FROM g),
e AS (SELECT *, length(regexp_extract(w, '(?s)^(.*)\\n\\n', 1)) AS para, regexp_matches(w, '\\n\\n') AS has_para, length(regexp_extract(w, '(?s)^(.*)[.!?] ', 1)) AS stop, regexp_matches(w, '[.!?] ') AS has_stop, length(regexp_extract(w, '(?s)^(.*) ', 1)) AS blank, contains(w, ' ') AS has_blank FROM w),
c AS (SELECT doc_id, pos, CASE WHEN pos * 800 + 1000 >= n THEN w WHEN has_para AND para > 500 THEN substring(w, 1, para + 2) WHEN has_stop AND stop > 500 THEN substring(w, 1, stop + 1) WHEN has_blank AND blank >= 500 THEN substring(w, 1, blank) ELSE w END AS c FROM e)
SELECT doc_id, cast(pos AS int) AS pos, md5(trim(c, ' ')) AS text FROM c WHERE trim(c, ' ') <> ''"""
)
def break_aware_chunks(spark, sf_dir):
    rows = _raw(spark, sf_dir, "documents").select("doc_id", F.explode(T.break_aware_chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.pos").alias("pos"), F.md5(F.col("c.text").cast("binary")).alias("text"))


def _sequential_sql(text: str, size: int, overlap: int, back: int, end: str) -> str:
    """The chunks as a recursion over their starts. ``end`` picks a chunk's end from m (where it would end by size), s
    (its start), n (the text's length) and w (its last ``back`` characters, reversed); all count from 0."""
    return (
        f"WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, x, length(x) AS n FROM (SELECT doc_id, {text} AS x FROM documents) WHERE length(x) > 0),"
        " c(r, k, s, e) AS (SELECT r, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL"
        f" SELECT r, k, s, CASE WHEN m = n THEN m ELSE {end} END FROM (SELECT *, reverse(substring(x, greatest(s, m - {back}) + 1, m - greatest(s, m - {back}))) AS w"
        f" FROM (SELECT *, least(s + {size}, n) AS m FROM (SELECT t.r, x, n, k + 1 AS k, CASE WHEN k < 0 THEN 0 ELSE greatest(s + 1, e - {overlap}) END AS s FROM c JOIN t ON c.r = t.r WHERE k < 0 OR e < n)))),"
        " p AS (SELECT r, k, doc_id, trim(substring(x, s + 1, e - s), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM c JOIN t USING (r) WHERE k >= 0)"
        " SELECT doc_id, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS pos, text FROM p WHERE text <> ''"
    )


def _last_sql(mark: str, takes: int = 0) -> str:
    """WHEN ... THEN the place of the last ``mark`` (reversed) in w, plus ``takes``, where it is after the start."""
    at = f"m - strpos(w, {mark}) + 1 - length({mark})"
    return f"WHEN strpos(w, {mark}) > 0 AND {at} > s THEN {at} + {takes}"


@query(_sequential_sql("replace(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' ')", 1000, 200, 100, f"CASE {_last_sql(chr(39) + ' .' + chr(39), 1)} {_last_sql(chr(39) + ' ' + chr(39))} ELSE m END"))
def sentence_chunks(spark, sf_dir):
    rows = _raw(spark, sf_dir, "documents").select("doc_id", F.explode(T.sequential_chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.pos").alias("pos"), F.col("c.text").alias("text"))


@query(_sequential_sql("substring(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), 1, 100000)", 1500, 150, 200, f"CASE {_last_sql('chr(10) || chr(10)')} {_last_sql('chr(10)')} ELSE m END"))
def paragraph_chunks(spark, sf_dir):
    rows = _raw(spark, sf_dir, "documents").select("doc_id", F.explode(T.sequential_chunks(F.col("text"), 1500, 150, "paragraph")).alias("c"))
    return rows.select("doc_id", F.col("c.pos").alias("pos"), F.col("c.text").alias("text"))


@query(
    """WITH t AS (SELECT doc_id, text, replace(text, chr(10), chr(10) || chr(10)) AS p, CASE WHEN length(text) <= 1500 THEN [text] ELSE list_transform(range(1 + cast(ceil((length(text) - 1500) / 1350.0) AS bigint)), lambda k: substring(text, cast(k * 1350 + 1 AS bigint), 1500)) END AS c FROM documents WHERE length(text) > 0),
x AS (SELECT doc_id, text, p, c, list_filter(list_transform(string_split(p, chr(10) || chr(10)), lambda v: trim(v, ' ')), lambda v, i: length(v) > 100 AND NOT list_contains(c, v) AND list_position(list_transform(string_split(p, chr(10) || chr(10)), lambda u: trim(u, ' ')), v) = i) AS more FROM t)
SELECT doc_id, md5(array_to_string(CASE WHEN len(c) < 20 AND length(p) > 2000 THEN c || more ELSE c END, '|')) AS chunks FROM x"""
)
def paragraph_supplement(spark, sf_dir):
    rows = _raw(spark, sf_dir, "documents").filter("length(text) > 0")
    cut = F.transform(T.fixed_chunks(F.col("text")), lambda c: c["text"])
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return rows.select("doc_id", F.md5(F.array_join(T.with_paragraphs(cut, spaced), "|").cast("binary")).alias("chunks"))


@query(f"WITH {DOCS_SQL}, s AS (SELECT id, filename, source_url, text, regexp_replace(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''), '^[0-9]{{14}}_', '') AS stem FROM docs) SELECT id, lower(trim(regexp_replace(stem, '[_-]+', ' ', 'g'))) AS title, regexp_extract(source_url, '^([a-z]+://[^/]+)', 1) AS origin, lower(regexp_replace(regexp_extract(source_url, '([^/]+)$', 1), '[-_]', ' ', 'g')) AS topic, 'https://x.org/t/' || regexp_replace(lower(lang), '{WS}', '-', 'g') AS topic_url, md5(text) AS key, md5(substring(text, 1, 1000)) AS short_key FROM s JOIN (SELECT id AS i, lang FROM docs) ON i = id")
def text_helpers(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select(
        "id", F.lower(T.display_title(F.col("filename"))).alias("title"), T.origin(F.col("source_url")).alias("origin"), F.lower(T.topic_name(F.col("source_url"))).alias("topic"),
        T.topic_url("https://x.org/t/", F.col("lang")).alias("topic_url"), T.text_key(F.col("text")).alias("key"), T.text_key(F.col("text"), 1000).alias("short_key"),
    )


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    from weftbase.operators.pages import titled

    return titled(_raw(spark, sf_dir, "pages")).select("page_id", "title")


_MARKED = """m AS (SELECT id, document_id, chunk_index, CASE WHEN id % 5 = 0 THEN text_content || ' see https://doi.org/10.1000/' || source || '.' || (document_id % 90) || '. And more' WHEN id % 5 = 1 THEN 'doi: 10.1000/xyz.' || (id % 30) || '; ' || text_content WHEN id % 5 = 2 THEN text_content || ' (10.1016/S0140-6736(20)32279-0)' ELSE text_content END AS t FROM chunks)"""


def _marked(spark, sf_dir):
    rows = wide_chunks(spark, sf_dir)
    t, at = F.col("text_content"), F.col("id") % 5
    made = (
        F.when(at == 0, F.concat(t, F.lit(" see https://doi.org/10.1000/"), "source", F.lit("."), (F.col("document_id") % 90).cast("string"), F.lit(". And more")))
        .when(at == 1, F.concat(F.lit("doi: 10.1000/xyz."), (F.col("id") % 30).cast("string"), F.lit("; "), t))
        .when(at == 2, F.concat(t, F.lit(" (10.1016/S0140-6736(20)32279-0)")))
        .otherwise(t)
    )
    return rows.select("id", "document_id", "chunk_index", made.alias("text_content"))


_STRICT = """regexp_replace(CASE WHEN id % 5 = 0 THEN '10.1000/' || regexp_extract(t, 'doi\\.org/10\\.1000/([^ ()<>"]+)', 1) WHEN id % 5 = 1 THEN '10.1000/xyz.' || (id % 30) WHEN id % 5 = 2 THEN '10.1016/S0140-6736' END, '[.,;:]+$', '')"""


@query(f"WITH {CHUNKS_SQL}, {_MARKED} SELECT id, {_STRICT} AS doi FROM m")
def doi_extraction(spark, sf_dir):
    return _marked(spark, sf_dir).select("id", D.extract(F.col("text_content")).alias("doi"))


@query(f"WITH {CHUNKS_SQL}, {_MARKED}, f AS (SELECT document_id, chunk_index, {_STRICT} AS doi FROM m) SELECT document_id, arg_min(doi, chunk_index) AS doi FROM f WHERE doi IS NOT NULL GROUP BY 1")
def first_doi(spark, sf_dir):
    return D.first_of_document(_marked(spark, sf_dir))


@query("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '(10.1000/A' || doc_id || ')' WHEN doc_id % 5 = 1 THEN 'https://doi.org/10.1000/B' || doc_id || '.' WHEN doc_id % 5 = 2 THEN 'DOI: 10.1000/C' || doc_id || ';' WHEN doc_id % 5 = 3 THEN 'none' END AS doi FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN '10.1000/' || substring('abc', cast(doc_id % 5 + 1 AS bigint), 1) || doc_id END AS doi FROM r")
def doi_keys(spark, sf_dir):
    i, at = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    given = F.when(at == 0, F.concat(F.lit("(10.1000/A"), i, F.lit(")"))).when(at == 1, F.concat(F.lit("https://doi.org/10.1000/B"), i, F.lit("."))).when(at == 2, F.concat(F.lit("DOI: 10.1000/C"), i, F.lit(";"))).when(at == 3, "none")
    return _raw(spark, sf_dir, "documents").select("doc_id", D.join_key(given).alias("doi"))


def _works(spark, sf_dir, low: int, high: int):
    """Work records made from documents: DOI, lists of title, container and authors, dates."""
    rows = documents(spark, sf_dir)
    rows = rows.groupBy((F.col("id") % 300).alias("n")).agg(F.min("id").alias("id"), F.min_by("lang", "id").alias("lang"), F.min_by("source", "id").alias("source")).filter((F.col("n") % 10 >= low) & (F.col("n") % 10 < high))
    author = lambda f, g: F.struct(F.lit(f).alias("family"), g.alias("given"))
    return rows.select(
        F.concat(F.lit("10.1000/KB."), F.col("n").cast("string")).alias("DOI"), F.array(F.concat(F.lit("Work "), F.col("n").cast("string"), F.lit(" "), "lang")).alias("title"), F.array("source").alias("container_title"),
        F.array(author("Smith", F.lit("Jane")), author("Doe", F.upper("lang"))).alias("author"), F.when(F.col("n") % 3 == 0, (1990 + F.col("n") % 30).cast("int")).alias("year_print"), F.lit(None).cast("int").alias("year_online"),
        F.lit(2001).alias("year_created"), (F.col("n") % 50).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lit("1-9").alias("page"),
    )


_WORKS = """w AS (SELECT id % 300 AS n, arg_min(lang, id) AS lang, arg_min(source, id) AS source FROM docs GROUP BY 1), wf AS (SELECT '10.1000/kb.' || n AS doi, n, 'Work ' || n || ' ' || lang AS title, source AS journal, 'Smith, Jane; Doe, ' || upper(lang) AS authors, cast(CASE WHEN n % 3 = 0 THEN 1990 + n % 30 ELSE 2001 END AS int) AS publication_year, cast(n % 50 AS varchar) AS volume, '1-9' AS pages FROM w)"""


@query(f"WITH {DOCS_SQL}, {_WORKS} SELECT d.id, d.doi, wf.title, wf.journal, wf.authors, wf.publication_year, wf.volume, wf.pages, CASE WHEN wf.n % 10 < 6 THEN 'primary' WHEN wf.n % 10 < 8 THEN 'fallback' END AS found_in FROM docs d LEFT JOIN wf ON wf.doi = d.doi AND wf.n % 10 < 8")
def doi_enrichment(spark, sf_dir):
    primary, fallback = D.work_fields(_works(spark, sf_dir, 0, 6)), D.work_fields(_works(spark, sf_dir, 4, 8))
    return D.enrich(documents(spark, sf_dir), primary, fallback).drop("issue")


def _authors():
    return F.expr("array(named_struct('family', 'Smith', 'given', 'Jane Q'), named_struct('family', 'Doe', 'given', lang), named_struct('family', 'Roe', 'given', null), named_struct('family', 'Lee', 'given', 'A.-B.'), named_struct('family', 'Kim', 'given', 'C'), named_struct('family', 'Fox', 'given', 'D'), named_struct('family', 'Ray', 'given', 'E'))")
_BIB = ("publication_year", "title", "journal", "volume", "issue", "pages", "doi")


@query(
    f"""WITH {DOCS_SQL}, a AS (SELECT *, cast(id % 8 AS int) AS n, ['Smith, J.Q.', 'Doe, ' || upper(substring(lang, 1, 1)) || '.', 'Roe', 'Lee, A.B.', 'Kim, C.', 'Fox, D.', 'Ray, E.'] AS l FROM docs)
SELECT id, concat_ws(' ', CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN l[1] WHEN n > 6 THEN array_to_string(l[1:6], ', ') || ', et al.' ELSE array_to_string(l[1:n - 1], ', ') || ', & ' || l[n] END,
 '(' || coalesce(cast(publication_year AS varchar), 'n.d.') || ').', title || '.', CASE WHEN journal IS NOT NULL THEN concat_ws(', ', '<em>' || journal || '</em>', volume || coalesce('(' || issue || ')', ''), pages) || '.' END, 'https://doi.org/' || doi) AS apa FROM a"""
)
def apa_citations(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("a", F.slice(_authors(), F.lit(1), (F.col("id") % 8).cast("int")))
    return rows.select("id", C.apa(F.col("a"), *[F.col(c) for c in _BIB]).alias("apa"))


@query(
    f"""WITH {DOCS_SQL} SELECT id, concat_ws(' ', authors || '.', title || '.', journal, '(' || publication_year || ')', volume || coalesce('(' || issue || ')', ''), ':' || pages, 'https://doi.org/' || doi) AS plain,
concat_ws(' ', CASE WHEN authors IS NOT NULL AND journal IS NOT NULL AND publication_year IS NOT NULL THEN authors || ' (' || publication_year || '). ' || title || '. ' || journal || '.' ELSE title || '. (PDF Document)' END, 'https://doi.org/' || doi) AS from_columns,
CASE WHEN source_url IS NOT NULL THEN upper(source[1]) || substring(source, 2) || ' Example. (2025). ' || title || '. Retrieved 2025-03-27, from ' || source_url END AS website,
CASE WHEN journal IS NOT NULL AND authors IS NOT NULL AND NOT coalesce(starts_with(title, journal), false) THEN split_part(authors, ';', 1) || ' et al. - ' || journal ELSE title END AS shown FROM docs"""
)
def column_citations(spark, sf_dir):
    rows = documents(spark, sf_dir)
    bib = [F.col(c) for c in _BIB]
    basic = C.from_columns(F.col("authors"), *[F.col(c) for c in ("publication_year", "title", "journal", "doi")])
    return rows.select("id", C.plain(F.col("authors"), *bib).alias("plain"), basic.alias("from_columns"), C.website(F.col("title"), F.col("source_url"), "2025-03-27").alias("website"), C.shown_title(F.col("title"), F.col("authors"), F.col("journal")).alias("shown"))


@query(f"WITH {DOCS_SQL}, n AS (SELECT id, lang, id % 30 AS y FROM docs) SELECT id, CASE WHEN id % 3 = 0 THEN 'Smith (' || (1990 + y) || ')' WHEN id % 3 = 1 THEN upper(lang[1]) || substring(lang, 2) || ' Notes ' || (1990 + y) || ' (' || (1990 + y) || ')' ELSE upper(lang[1]) || substring(lang, 2) || ' Notes (n.d.)' END || '. Retrieved 2025-03-27' AS citation FROM n")
def filename_citations(spark, sf_dir):
    y = (1990 + F.col("id") % 30).cast("string")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("20250327145551_smith"), y, F.lit(".pdf"))).when(F.col("id") % 3 == 1, F.concat("lang", F.lit("_notes_"), y, F.lit(".pdf"))).otherwise(F.concat("lang", F.lit("-notes.pdf")))
    return documents(spark, sf_dir).select("id", C.from_filename(name, "2025-03-27").alias("citation"))


@query(f"WITH {DOCS_SQL}, w AS (SELECT DISTINCT doi FROM docs WHERE id % 3 = 1), c AS (SELECT id, CASE WHEN file_type = 'website' THEN 'Website: ' || title || coalesce(' (Page ' || (id % 4) || ')', '') || ' - ' || source_url ELSE coalesce(CASE WHEN id % 9 = 0 THEN 'Stored' END, nullif(formatted_citation, ''), CASE WHEN w.doi IS NOT NULL THEN 'A, B. Work ' || substring(w.doi, 12) || '. J (2001) https://doi.org/' || w.doi END, title || '. https://doi.org/' || docs.doi, title) END AS c, [cast(id % 4 AS varchar), '7'][1:cast(id % 3 AS int)] AS p FROM docs LEFT JOIN w ON docs.doi = w.doi) SELECT id, CASE WHEN contains(c, '(page') THEN c ELSE c || CASE len(p) WHEN 0 THEN '' WHEN 1 THEN ' (page ' || p[1] || ')' ELSE ' (pages ' || array_to_string(p, ', ') || ')' END END AS citation FROM c")
def source_citations(spark, sf_dir):
    """The citation of a work record comes by a join on the DOI."""
    docs = documents(spark, sf_dir)
    works = docs.filter("id % 3 = 1").select("doi").distinct().filter("doi is not null")
    none = F.lit(None).cast("string")
    record = C.plain(F.lit("A, B"), F.lit(2001), F.concat(F.lit("Work "), F.expr("substring(doi, 12)")), F.lit("J"), none, none, none, F.col("doi"))
    rows = docs.join(works.withColumn("record", record), "doi", "left")
    cited = C.source_citation(F.when(F.col("id") % 9 == 0, "Stored"), F.nullif("formatted_citation", F.lit("")), F.col("record"), F.col("title"), F.col("doi"), F.lit(""), F.col("file_type") == "website", F.col("source_url"), F.col("id") % 4)
    pages = F.slice(F.array((F.col("id") % 4).cast("string"), F.lit("7")), F.lit(1), (F.col("id") % 3).cast("int"))
    return rows.select("id", C.with_pages(cited, pages).alias("citation"))


@query(f"WITH {DOCS_SQL} SELECT id, CASE WHEN processing_state LIKE '{{%' THEN 'processing' ELSE 'unknown' END AS status, CASE WHEN processing_state LIKE '{{%' THEN cast(floor(100.0 * (id % 7) / (id % 90 + 10)) AS int) ELSE 0 END AS percent FROM docs")
def processing_states(spark, sf_dir):
    state = processing_state(F.col("processing_state"))
    return documents(spark, sf_dir).select("id", state["status"].alias("status"), state_percent(state).alias("percent"))


# Answers: conversations with marks appended, and four sources whose first and third have one title

_ANSWERS = "ans AS (SELECT conv_id, turn, text || ' [' || (turn % 6) || '][' || (turn % 6) || '][' || (conv_id % 4 + 1) || '] and [3]' AS a FROM conversations)"


def _answers(spark, sf_dir):
    rows = _raw(spark, sf_dir, "conversations")
    mark = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    made = F.concat("text", F.lit(" "), mark(F.col("turn") % 6), mark(F.col("turn") % 6), mark(F.col("conv_id") % 4 + 1), F.lit(" and [3]"))
    return rows.select("conv_id", "turn", made.alias("a"))


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS cited FROM (SELECT conv_id, turn, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_position(r, r[i]) = i THEN r[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: cast(x AS int)) AS r FROM ans))")
def cited_numbers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(A.cited(F.col("a")), lambda x: x.cast("string")), ",").alias("cited"))


@query(
    f"""WITH {_ANSWERS}, s AS (SELECT conv_id, turn, a, list_sort(list_filter(list_distinct([turn % 6, conv_id % 4 + 1, 3]), lambda x: x BETWEEN 1 AND 4)) AS k FROM ans),
t AS (SELECT *, list_transform(k, lambda x: CASE WHEN x IN (1, 3) THEN 1 ELSE x END) AS g FROM s),
o AS (SELECT *, list_filter(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN list_position(g, g[i]) = i THEN g[i] END), lambda x: x IS NOT NULL) AS d FROM t)
SELECT conv_id, turn, regexp_replace(a, '( )\\[[0-9]+\\]\\[[0-9]+\\]\\[[0-9]+\\] and \\[3\\]$', '\\1')
 || CASE WHEN turn % 6 BETWEEN 1 AND 4 THEN repeat('[' || list_position(d, CASE WHEN turn % 6 IN (1, 3) THEN 1 ELSE turn % 6 END) || ']', 2) ELSE '' END
 || '[' || list_position(d, CASE WHEN conv_id % 4 + 1 IN (1, 3) THEN 1 ELSE conv_id % 4 + 1 END) || '] and [' || list_position(d, 1) || ']' AS answer FROM o"""
)
def renumbered_answers(spark, sf_dir):
    titles = F.array(F.lit("One"), F.lit("Two"), F.lit("One"), F.lit("Four"))
    return _answers(spark, sf_dir).select("conv_id", "turn", A.renumbered(F.col("a"), titles).alias("answer"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ') || ' [' || (turn % 6) || '] [' || (turn % 6 + 1) || ']' AS answer FROM conversations")
def tidied_answers(spark, sf_dir):
    rows = _raw(spark, sf_dir, "conversations")
    mark = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    made = F.concat(F.trim("text"), F.lit(" "), mark(F.col("turn") % 6), mark(F.col("turn") % 6), mark(F.col("turn") % 6 + 1), F.lit("\n\n\n\nSources:\n[1] One"))
    return rows.select("conv_id", "turn", A.tidy(made).alias("answer"))


_PAGE = {
    "document_id": "document_id",
    "page_number": "chunk_index + 1",
    "text": "concat(text_content, CASE WHEN chunk_index = 0 AND document_id % 3 = 0 THEN concat(' see 10.1000/first.', cast(document_id as string), ' end') WHEN chunk_index = 1 THEN ' and 10.1000/body.1 end' WHEN chunk_index = 2 AND document_id % 5 = 0 THEN ' References 10.1000/ref.7 end' ELSE '' END)",
    "header_text": "CASE WHEN chunk_index = 1 AND document_id % 2 = 0 THEN concat('DOI:10.1000/head.', cast(document_id as string)) END",
    "footer_text": "CASE WHEN chunk_index = 3 THEN '10.1000/foot.3 p. 4' END",
}
_PAGED = f"pg AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PAGE.items())} FROM chunks)"


@query(
    f"""WITH {CHUNKS_SQL}, {_PAGED}, w AS (SELECT document_id, page_number, CASE WHEN page_number = 1 OR page_number <= 5 AND regexp_matches(text, '(?i)\\b(references|bibliography)\\b') THEN text ELSE concat_ws(chr(10), header_text, footer_text) END AS t FROM pg),
f AS (SELECT document_id, page_number, nullif(regexp_extract(t, '(10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1), '') AS doi FROM w) SELECT document_id, arg_min(doi, page_number) AS doi FROM f WHERE doi IS NOT NULL GROUP BY 1"""
)
def doi_by_page(spark, sf_dir):
    """DOIs by the policy of pages: where on a page one counts depends on the page."""
    pages = wide_chunks(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _PAGE.items()])
    return D.first_of_pages(pages)


@query(
    f"""WITH {DOCS_SQL} SELECT '10.5000/' || id AS doi, CASE WHEN id % 3 = 0 THEN NULL ELSE 'About ' || source END AS title, CASE WHEN id % 4 = 0 THEN source END AS journal, 'Smith, J; Doe, ' || lang AS authors,
cast(CASE WHEN id % 2 = 0 THEN 1990 + id % 30 WHEN id % 5 <> 0 THEN 1980 + id % 7 END AS int) AS publication_year FROM docs"""
)
def datacite_records(spark, sf_dir):
    """Records in DataCite's shape, written as JSON and read back to fields."""
    docs = documents(spark, sf_dir).drop("text")
    date = lambda kind, d: F.struct(d.alias("date"), F.lit(kind).alias("dateType"))
    issued = F.when(F.col("id") % 5 == 0, F.lit("unknown")).otherwise(F.concat((1980 + F.col("id") % 7).cast("string"), F.lit("-03-01")))
    records = docs.select(
        F.concat(F.lit("https://doi.org/10.5000/"), F.col("id").cast("string")).alias("doi"), F.array(F.struct(F.lit(None).cast("string").alias("title")), F.struct(F.when(F.col("id") % 3 != 0, F.concat(F.lit("About "), "source")).alias("title"))).alias("titles"),
        F.when(F.col("id") % 4 == 0, F.struct(F.col("source").alias("title"))).alias("container"), F.array(F.struct(F.lit("Smith, J").alias("name")), F.struct(F.concat(F.lit("Doe, "), "lang").alias("name"))).alias("creators"),
        F.when(F.col("id") % 2 == 0, 1990 + F.col("id") % 30).alias("publicationYear"), F.array(date("Created", F.lit("1970")), date("Issued", issued)).alias("dates"),
    )
    path = scratch_path(spark, "datacite")
    records.write.json(path)
    return D.datacite_fields(tables.read_datacite(spark, path)).drop("volume", "issue", "pages")
