"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.llm import additive, alignment, contamination, divergence, jaccard_join, langid, mixing, neighbours, paragraphs, pieces, prefix_trie, repeat_bytes, secrets
from weftbase.llm.scratch import keep

#: A public SentencePiece model: WEFT_PIECES names another.
PIECES = os.environ.get("WEFT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: A public byte-level BPE vocabulary: WEFT_BYTES names another.
BYTES = os.environ.get("WEFT_BYTES", "/opt/tokenizers/byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; null doc_id: null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "slots", "first_slot")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = langid.train(docs.filter(fold(5) != 0))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep_text=False)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op4_repeat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_bytes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("member", "component")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(neighbours.build_index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECES, keep_text=False).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    table = keep(additive.feature_table(_table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    labels = _table(spark, sf_dir, "labels")
    model = additive.train(table, labels.filter(fold(3) != 1))
    scored = additive.score(table, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs, divergence.references(docs), keep_text=False).drop("lang")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, PIECES)


def op13_query(docs: DataFrame, benchmark: DataFrame, part: int = contamination.PART) -> DataFrame:
    found = contamination.contaminated(docs.select("doc_id", "text"), benchmark, part)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_repeat_bytes": op4_repeat_bytes,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_decontamination": op13_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(text, '') AS text, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, id, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS i FROM t),
bits(b, x, k) AS (SELECT b, b, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY b) AS table_ FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t),
fold(c, s, i, x) AS (SELECT c, s, 1, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, s, i + 1, xor(x >> 8, (SELECT table_ FROM crc)[CAST(xor(x & 255, ascii(s[i])) AS INT) + 1]) FROM fold WHERE i <= length(s)),
h AS (SELECT c, c - c % 5 AS base, xor(x, 4294967295) % 9 AS h FROM fold WHERE i = length(s) + 1),
r AS (SELECT h.c, o.id, o.size, o.i AS p FROM h JOIN o ON o.c = h.base WHERE o.i <= h.h UNION ALL SELECT h.c, o.id, o.size, o.i + 1000000000 FROM h JOIN o ON o.c = h.c WHERE o.i > h.h),
q AS (SELECT c, id, size, row_number() OVER w AS d, string_agg(id, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
member AS (SELECT c, 0 AS d, '' AS path, 0 AS size FROM ids UNION ALL SELECT c, d, path, size FROM q),
len AS (SELECT c, max(d) AS n FROM member GROUP BY c),
node AS (SELECT path, any_value(d) AS d, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n) AS ends FROM member JOIN len USING (c) GROUP BY path),
up AS (SELECT k.path, k.d, k.size, k.conv_id, k.n_convs, k.ends, a.conv_id AS parent, k.path IN (SELECT left(path, length(path) - 32) FROM node WHERE d > 0) AS inner_ FROM node k LEFT JOIN node a ON k.d > 0 AND a.path = left(k.path, length(k.path) - 32)),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT left(k.path, 32 * j) AS path, count(*) FILTER (WHERE NOT inner_) AS leaves, sum((n_convs - 1) * size) AS saved FROM up k, unnest(range(0, d + 1)) x(j) GROUP BY 1)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM up u JOIN sub USING (path) LEFT JOIN kids USING (path)
""",
    "op13_decontamination": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, w[i : i + n - 1] AS words FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
found AS (SELECT r, i, p.n, item_id FROM (SELECT r, i, n, w[i : i + n - 1] AS words FROM place, (SELECT DISTINCT n FROM item) WHERE i + n - 1 <= len(w)) p JOIN item USING (words)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
}
