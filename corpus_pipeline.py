"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase.llm import jaccard_join, langid, mixing, pieces, secrets
from weftbase.llm.queries import PIECES
from weftbase.llm.scratch import keep

#: Texts whose best language weighs less than this among all are rejected, as are texts without letters.
LEAST_SCORE = 0.5
#: So are texts of LONG bytes or more that cost so many robust spreads more bits a byte than their language's median.
LONG, SPREADS = 200, 12
HAS_WORD = r"[^\x20\x09-\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are text of some language: with a score of LEAST_SCORE or more, and about as
    predictable as others of that language. Where no row has a lang to learn from, all that have a letter stay."""
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    model = spark.sparkContext.broadcast(model)
    sizes = docs.filter(F.octet_length("text") >= LONG).select("text")
    costs = keep(langid.identify(sizes, model, keep_text=False).filter("lang_pred != 'und'"), "costs", free=True)
    middle = costs.groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", 0.5, 1000).alias("middle"))
    off = costs.join(F.broadcast(middle), "lang_pred").groupBy("lang_pred", "middle").agg(F.percentile_approx(F.abs(F.col("bits_per_byte") - F.col("middle")), 0.5, 1000).alias("off"))
    # one row a language
    bars = off.select(F.col("lang_pred").alias("_named"), (F.col("middle") + SPREADS * 1.4826 * F.col("off")).alias("_bar"))
    found = langid.identify(docs, model).join(F.broadcast(bars), F.col("lang_pred") == F.col("_named"), "left")
    odd = F.coalesce((F.octet_length("text") >= LONG) & (F.col("bits_per_byte") > F.col("_bar")), F.lit(False))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & ~odd).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents that of the least doc_id, once; of rows that share it, any one.
    Rows without words stay."""
    marked = docs.withColumn("_print", F.xxhash64("text"))
    groups = jaccard_join.similar_documents(marked.select("doc_id", "text", "_print")).filter("n_shingles > 0")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_print")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_first_id"), F.col("first._print").alias("_first_print"))
    worded = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col("_first_id")) & (F.col("_print") == F.col("_first_print"))
    single = marked.filter(worded).join(first, same, "left_semi").dropDuplicates(["doc_id", "_print"])
    return single.select(*docs.columns).union(docs.filter(~worded))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; every secret in them becomes a mark, and n_chars follows."""
    found = secrets.find_secrets(docs)
    found = found.withColumn("_redacted", secrets.redact(F.col("text"), F.col("secrets")))
    made = {"text": F.col("_redacted"), "n_chars": F.when(F.size("secrets") > 0, F.length("_redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to their target weights: a document comes as often as the mix takes its words, to the
    nearest whole number, which may be never; so do documents without words."""
    taken = mixing.taken_words(docs)
    copies = taken.filter("size > 0").select("doc_id", "print", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies"))
    copies = copies.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_same")).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    drawn = docs.withColumn("_print", F.xxhash64("text", "source")).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_same")))
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' ids of each document, for training: doc_id, lang, source, n_ids, ids."""
    made = pieces.encode(docs.select("doc_id", "text", "lang", "source"), PIECES, keep_text=False)
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]
#: SQL cannot express the trained and the iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
