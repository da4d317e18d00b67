"""Mix sources to target weights with a low-discrepancy schedule of equal-word blocks.

Each source's documents are put in a seeded random order and laid end to end as a stream of words, which
starts over when the mix needs more than it holds. The stream is cut into blocks of ``block_words`` words.
Slot i of the schedule belongs to the source in whose share of the unit interval the golden-ratio point
frac(i * phi) falls; the k-th slot of a source takes the k-th block of its stream. Any stretch of the
schedule therefore holds the sources close to their weights.

Nothing gathers a source in one task: stream offsets and slot ranks are prefix sums in two steps, within
runs of bounded length and over the runs' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
#: floor(2**32 / golden ratio), made odd: i * GOLDEN mod 2**32 is the point of slot i.
GOLDEN = 2654435769
RUN = 4096
BINS = 4096


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row per source: source_size, n_docs, weight, target, source_no.

    Sources in code-point order (null last) take ``weights`` in turn. Targets share the words of all
    sources by weight; none exceeds ``max_repeats`` times its source, and what is cut off goes to the
    others by weight. With sources ordered by cap over weight, those held at their caps are a prefix, and
    the level of the rest follows from prefix sums: no iteration.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    stats = stats.withColumn("source_no", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    stats = stats.withColumn("weight", F.element_at(cycle, (F.col("source_no") - 1) % len(weights) + 1))
    stats = stats.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stats = stats.select(
        "*",
        F.row_number().over(order).alias("at"),
        (
            (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    held = F.col("cap") / F.col("weight") <= F.col("level")
    common = F.min(F.when(~held, F.struct("at", "level"))).over(every)["level"]
    target = F.when(held, F.col("cap")).otherwise(F.col("weight") * common)
    return stats.select("source_no", "source", "source_size", "n_docs", "weight", target.alias("target"))


def streams(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Where each row's words begin in the shuffled stream of its source (``begin``)."""
    key = F.xxhash64(F.lit(seed), "doc_id", "print")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / RUN))).cast("int")
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "row_id", "doc_id", "print", "size", "source_no", "source_size", "target", key.alias("key"), bits.alias("bits")
    )
    rows = rows.withColumn("run", F.expr("pmod(key, cast(shiftleft(1L, bits) as bigint))"))
    runs = rows.groupBy("source_no", "run").agg(F.sum("size").alias("run_size"))
    ahead = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_no", "run", F.coalesce(F.sum("run_size").over(ahead), F.lit(0)).alias("run_begin"))
    within = Window.partitionBy("source_no", "run").orderBy("key", "doc_id", "print", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(runs, ["source_no", "run"]).withColumn("begin", F.col("begin") + F.col("run_begin")).drop("run", "run_begin", "key", "print", "bits")


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """The slots: slot, source_no, rank (of the slot within its source, from 0)."""
    spark = targets.sparkSession
    every = Window.partitionBy()
    need = targets.select("source_no", F.ceil(F.col("target") / block_words).cast("long").alias("need")).filter("need > 0")
    up_to = Window.orderBy("source_no")
    need = need.select("source_no", "need", F.sum("need").over(up_to).alias("upto"), F.sum("need").over(every).alias("total"))
    scale = F.lit(float(1 << 32))
    need = need.select("source_no", "need", "total", F.floor((F.col("upto") - F.col("need")) / F.col("total") * scale).alias("low"), F.floor(F.col("upto") / F.col("total") * scale).alias("high"))
    first = need.select("total").head()
    total = first["total"] if first else 0
    share = need.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / ((1 << 32) // BINS)), F.floor((F.col("high") - 1) / ((1 << 32) // BINS))))).filter("high > low")
    low16, high16 = F.col("slot").bitwiseAND(0xFFFF), F.shiftright(F.col("slot"), 16).bitwiseAND(0xFFFF)
    point = (low16 * GOLDEN + F.shiftleft((high16 * GOLDEN).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("point", point)
    slots = slots.withColumn("bin", F.floor(F.col("point") / ((1 << 32) // BINS)))
    slots = slots.join(share, "bin").filter("point >= low and point < high").select("slot", "source_no", F.floor(F.col("slot") / (16 * RUN)).alias("run"))
    counts = slots.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "run", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("source_no", "run").orderBy("slot")
    body = (
        slots.withColumn("at", F.row_number().over(within) - 1)
        .join(counts.drop("n"), ["source_no", "run"])
        .select("slot", "source_no", (F.col("earlier") + F.col("at")).alias("rank"))
        .join(need.select("source_no", "need"), "source_no")
        .filter("rank < need")
        .drop("need")
    )
    #: The points meet each share to within a few slots; those that a source still lacks come last.
    made = counts.groupBy("source_no").agg(F.sum("n").alias("made"))
    lacking = need.join(made, "source_no", "left").withColumn("made", F.coalesce("made", F.lit(0))).filter("made < need")
    lacking = lacking.withColumn("at", F.sum(F.col("need") - F.col("made")).over(up_to) - (F.col("need") - F.col("made")))
    tail = lacking.select("source_no", "at", "made", F.explode(F.expr("sequence(made, need - 1)")).alias("rank"))
    return body.unionByName(tail.select((F.lit(total) + F.col("at") + F.col("rank") - F.col("made")).alias("slot"), "source_no", "rank"))


def mix_sources(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, block_words: int = 2048, seed: int = 20240229
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``sizes`` (row_id, doc_id, source, size, and print: a hash of what else tells rows apart, needed
    only where doc_id does not; row_id without repeats).

    Returns (pieces, targets). A piece is a stretch of one document in one slot: slot, source_no, epoch
    (0: first pass over the source), row_id, doc_id, from_word, to_word (exclusive). A source's pieces add
    up to its rounded target. Rows of size 0 have no piece; a null source is a source of its own; no rows
    give no pieces. The same rows and seed give the same mix, however they are split and ordered: row_id decides
    only between rows that are equal otherwise.
    """
    if "print" not in sizes.columns:
        sizes = sizes.withColumn("print", F.lit(0).cast("long"))
    targets = keep(source_targets(sizes, weights, max_repeats), "targets")
    slots = keep(schedule(targets, block_words), "slots", free=True)
    rows = streams(sizes.filter("size > 0"), targets, seed)
    limit = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    rows = rows.withColumn("limit", limit).withColumn("epoch", F.explode(F.expr(f"sequence(0, {max_repeats - 1})")))
    rows = rows.withColumn("from_at", F.col("epoch") * F.col("source_size") + F.col("begin"))
    rows = rows.withColumn("to_at", F.least(F.col("from_at") + F.col("size"), "limit")).filter("from_at < to_at")
    rows = rows.withColumn("rank", F.explode(F.expr(f"sequence(from_at div {block_words}, (to_at - 1) div {block_words})")))
    begin = F.greatest("from_at", F.col("rank") * block_words)
    end = F.least("to_at", (F.col("rank") + 1) * block_words)
    pieces = rows.join(slots, ["source_no", "rank"]).select(
        "slot", "source_no", "epoch", "row_id", "doc_id", (begin - F.col("from_at")).alias("from_word"), (end - F.col("from_at")).alias("to_word")
    )
    return pieces, targets


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): row_id, doc_id, print, source, size, source_size, target,
    taken, slots and first_slot (how many slots of the schedule hold words of it, and the first of them).

    Null text has size 0; what has no words is in no slot. Rows that repeat a doc_id are rows of their own, equal
    ones share what they take in no particular order. Other columns are left aside.
    """
    print_ = F.xxhash64("text", "source").alias("print")
    sizes = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", print_, "source", word_count(F.col("text")).alias("size"))
    sizes = keep(sizes, "sizes")
    pieces, targets = mix_sources(sizes, **how)
    taken = pieces.groupBy("row_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.count(F.lit(1)).alias("slots"), F.min("slot").alias("first_slot"))
    taken = keep(taken, "taken", free=True)
    rows = sizes.join(taken, "row_id", "left")
    return rows.join(targets.withColumnRenamed("source", "named"), rows["source"].eqNullSafe(F.col("named"))).select(
        "row_id", "doc_id", "print", rows["source"], "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "slots")], "first_slot"
    )
