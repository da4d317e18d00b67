"""Links between sets that share keys: candidate pairs without all pairs of a group, and exact checks.

Members are ids of distinct sets (equal sets are one member). The first rounds compare each member with
pivots of the keys it has, so a group of m near copies costs about m checks. What ends in one component
needs no further check; the last round then looks at every pair of different components that the keys
leave open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep
from weftbase.llm.textbatch import lean

Check = Callable[[DataFrame], DataFrame]
#: Shared tokens that ``within_tiles`` counts at once, and tokens of a slice.
STRIP = 4096
SLICE = 250_000


def verify(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity, exactly. ``sets``: member, n,
    tokens (binary: sorted distinct 64-bit values). Only the sets that the pairs name travel."""
    num, den = share
    pairs = keep(pairs, "pairs", free=True)
    members = keep(pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct(), "members")
    own = sets.join(members, "member", "left_semi")
    left = own.select(F.col("member").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = own.select(F.col("member").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").filter((F.least("na", "nb") * den) >= (F.greatest("na", "nb") * num))

    @lean
    def check(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                m = np.sort(np.concatenate([p, q]))
                common = int((m[1:] == m[:-1]).sum())
                ok[i] = den * common >= num * (len(p) + len(q) - common)
            keep_ = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep_), batch.column("b").filter(keep_)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def within_tiles(open_: DataFrame, sets: DataFrame, few: int, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Links (a, b) that join what is similar across the components of each key of more than ``few`` members,
    exactly. ``open_``: key, member, component.

    Sets of one key are dealt by size, as sizes further apart than ``share`` cannot be similar, then into slices
    of about four times ``few``, fewer where sets are large; a task compares the sets of two slices at a time, so
    pairs never become rows.
    """
    num, den = share
    large = open_.groupBy("key").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > few)
    rows = open_.join(large.select("key"), "key").join(sets.select("member", "n"), "member")
    rows = rows.withColumn("size", F.floor(F.log("n") / float(np.log(den / num) + 1e-9)))
    # of like size: in the group of its own size, and of the next one
    rows = rows.withColumn("size", F.explode(F.array("size", F.expr("size + 1"))))
    slices = rows.groupBy("key", "size").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (4 * few), F.sum("n") / SLICE)).alias("slices"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(slices.filter("low != high").drop("low", "high"), ["key", "size"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("member", "key"), "slices")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("slices - 1"))))
    rows = rows.select("key", "size", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "member", "component").join(sets.select("member", "tokens"), "member")

    def compare(table: pa.Table) -> pa.Table:
        member, component = (table.column(c).to_numpy() for c in ("member", "component"))
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        n = np.array([len(x) for x in tokens])
        _, at, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        use = often[at] > 1
        owner, at = np.repeat(np.arange(len(n)), n)[use], np.unique(at[use], return_inverse=True)[1]
        common = np.zeros((len(n), len(n)), np.float32)
        for low in range(0, int(at.max(initial=-1)) + 1, STRIP):
            own = (at >= low) & (at < low + STRIP)
            held = np.zeros((len(n), STRIP), np.float32)
            held[owner[own], at[own] - low] = 1
            common += held @ held.T
        common = common.astype(np.int64)
        like = den * common >= num * (n[:, None] + n[None, :] - common)
        like &= component[:, None] != component[None, :]
        a, b = np.nonzero(np.triu(like))
        label = np.arange(len(n))
        while True:  # as few links as join them
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(n)))
        x, y = member[own], member[label[own]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return rows.groupBy("key", "size", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _best_pivots(pairs: DataFrame, n: int) -> DataFrame:
    """For each member the ``n`` pivots with which it shares most keys."""
    counted = pairs.groupBy("member", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    top = Window.partitionBy("member").orderBy(F.desc("shared"), "pivot")
    chosen = counted.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= n)
    return chosen.select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b")).distinct()


def star_rounds(keys: DataFrame, sets: DataFrame, rounds: int, check: Check, pivots: int = 2) -> tuple[DataFrame, DataFrame]:
    """(links, labels): ``keys`` is (key, member). The first round compares members with the least member of
    their keys; each later one with the members of the least and the greatest label of their keys, where a
    key has more than one label."""
    first = keys.groupBy("key").agg(F.min("member").alias("pivot"))
    pairs = keys.join(first, "key").filter("member != pivot").select("member", "pivot")
    links = keep(verify(check(_best_pivots(pairs, pivots)), sets), "links", free=True)
    for _ in range(rounds - 1):
        own = open_keys(keys, labels(links))
        ends = own.groupBy("key").agg(F.min(F.struct("component", "member")).alias("low"), F.max(F.struct("component", "member")).alias("high"))
        both = own.join(ends, "key")
        pairs = both.filter(F.col("component") != F.col("low.component")).select("member", F.col("low.member").alias("pivot"))
        pairs = pairs.union(both.filter(F.col("component") != F.col("high.component")).select("member", F.col("high.member").alias("pivot")))
        new = keep(verify(check(_best_pivots(pairs, pivots)), sets), "links", free=True)
        if new.isEmpty():
            break
        links = links.union(new)
    return links, keep(labels(links), "labels", free=True)


def pair_groups(open_: DataFrame) -> DataFrame:
    """(key, member, component): groups in which every two members of a key of ``open_`` (the same columns) meet.

    Keys of the same members are one group. So are all keys that have their least member in common, where all
    pairs of their members are fewer than the keys' pairs: near copies of one text share many keys, each of most
    of them.
    """
    lists = open_.groupBy("key").agg(F.bit_xor(F.xxhash64("member")).alias("list"), F.count(F.lit(1)).alias("n"), F.min("member").alias("pivot"))
    lists = keep(lists.groupBy("pivot", "list", "n").agg(F.min("key").alias("key")), "lists")
    rows = keep(open_.join(lists.select("key", "pivot"), "key"), "rows", free=True)
    size = rows.select("pivot", "member").distinct().groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    each = lists.groupBy("pivot").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    together = keep(each.join(size, "pivot").filter("size * size <= pairs").select("pivot", F.lit(True).alias("together")), "together")
    groups = lists.join(together, "pivot", "left").select("key", F.when(F.col("together"), F.col("pivot")).otherwise(F.col("key")).alias("group"))
    return rows.join(groups, "key").groupBy(F.col("group").alias("key"), "member").agg(F.first("component").alias("component"))


def linked(keys: DataFrame, sets: DataFrame, few: int, rounds: int = 3, check: Check = lambda pairs: pairs) -> DataFrame:
    """Links (a, b) that join all that is similar and shares a key, exactly. ``keys``: key, member; ``sets``: member,
    n, tokens; ``check`` leaves of candidate pairs those worth a comparison."""
    links, found = star_rounds(keys, sets, rounds, check)
    groups = keep(pair_groups(open_keys(keys, found)), "groups", free=True)
    small = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= few).select("key")
    rows = groups.join(small, "key")
    x, y = (rows.select("key", F.col("member").alias(m), F.col("component").alias(c)) for m, c in (("a", "x"), ("b", "y")))
    pairs = x.join(y, "key").filter("a < b and x != y").select("a", "b").distinct()
    rest = verify(check(pairs), sets).union(within_tiles(groups, sets, few))
    return links.union(keep(rest, "links", free=True))


def labels(links: DataFrame) -> DataFrame:
    """(node, component): the least member linked with a node, or linked with that one. A step towards the
    components that needs no iteration: equal labels mean one component, one component can have several."""
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    again = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return least.join(again, "component", "left").select("node", F.coalesce("further", "component").alias("component"))


def with_components(keys: DataFrame, found: DataFrame) -> DataFrame:
    return keys.join(found.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))


def open_keys(keys: DataFrame, found: DataFrame) -> DataFrame:
    """``keys`` with each member's component, only of keys that have more than one component."""
    own = with_components(keys, found)
    ends = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return keep(own.join(ends.filter("low != high").select("key"), "key"), "open", free=True)
