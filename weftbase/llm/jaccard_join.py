"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets x and y of similarity 0.8 or more have at least c = ceil(4/9 (|x| + |y|)) shingles in common. In any order
of all shingles, they have at least l in common among the first |x| - c + l of x and |y| - c + l of y.

1. *Candidates.* In the order of the shingles' hashes, a document's prefix takes a share of its size more than it
   must. Documents whose prefixes share too few shingles with any others are done.
2. *Prefixes.* Of the candidates, shingles are ordered by how many candidates have them, the rarest first. A
   prefix is longer by the logarithm of its estimated candidate cost (how many other sets have its shingles), and
   a pair needs correspondingly more shared prefix shingles before its sets are compared.
3. *Links.* Each set is compared with pivots of its keys first, so that a group of near copies costs about as many
   comparisons as it has members. Only keys that still hold two components or more are looked at pair by pair:
   keys of the same members once, keys with the same first member as one group where that makes fewer pairs, and
   large groups in tiles within tasks.

Documents with equal sets are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftbase.llm import links as L
from weftbase.llm.components import components
from weftbase.llm.repeats import ROUTED, repeated, routed
from weftbase.llm.scratch import keep, without
from weftbase.llm.textbatch import LEAN, Block, blocks, lean, mix64, segment_sums, shingle_hashes, signed, word_hashes, words

WIDTH = 5
#: A prefix by hash takes LEAST shingles, and one for every SHARE of the set, more than it must.
LEAST, SHARE = 12, 20
#: Sets at least this large can take LEAST shingles more, and so can all sets similar to them.
FULL = 40
#: A prefix by frequency is one shingle longer whenever its candidate cost over CHEAP doubles.
CHEAP = 16
#: About so many prefix shingles are looked at together: those that repeat among them need no partner.
TOGETHER = 500_000
#: Groups of more members are compared in tiles within tasks.
FEW = 128


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and the offsets of each."""
    w = words(block)
    hashes, owner = shingle_hashes(word_hashes(block, w, fold=True), w, WIDTH)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(block) + 1))


def set_names(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: the same for the same set."""
    n = np.diff(offsets).astype(np.uint64)
    return mix64(segment_sums(mix64(hashes), offsets) + n * np.uint64(0x9E3779B97F4A7C15))


def prefix_base(n):
    """|x| - ceil(0.8 |x|) + 1: prefix length at l = 1, whatever the partner."""
    return n - (4 * n + 4) // 5 + 1


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, text among them) with n_shingles and member (the name of its set) in place of
    the text. Null and empty texts have the empty set."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*rest]).add("n_shingles", "long").add("member", "long")

    @lean
    def run(batches):
        for batch in batches:
            n, names = [], []
            for block in blocks(batch.column("text"), LEAN):
                hashes, at = shingle_sets(block)
                n.append(np.diff(at))
                names.append(set_names(hashes, at))
            made = [pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(signed(np.concatenate(names)) if names else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *made], schema.names)

    return docs.mapInArrow(run, schema)


def prefixes(docs: DataFrame) -> DataFrame:
    """Exchange rows of the prefix shingles by hash: key is a shingle, member a set."""

    @lean
    def run(batches):
        keys, members = [], []
        for batch in batches:
            for block in blocks(batch.column("text"), LEAN):
                hashes, at = shingle_sets(block)
                n, names = np.diff(at), set_names(hashes, at)
                _, one = np.unique(names, return_index=True)
                least = np.zeros(len(n), np.int64)
                least[one] = np.minimum(prefix_base(n[one]) + LEAST + n[one] // SHARE, n[one])
                use = np.arange(len(hashes)) - np.repeat(at[:-1], n) < np.repeat(least, n)
                keys.append(hashes[use])
                members.append(np.repeat(names, least))
                if sum(map(len, keys)) > TOGETHER:
                    yield routed(np.concatenate(keys), np.concatenate(members))
                    keys, members = [], []
        if keys:
            yield routed(np.concatenate(keys), np.concatenate(members))

    return docs.select("text").mapInArrow(run, ROUTED)


def candidates(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``named`` (member, n and others) whose prefixes by hash share enough with those of others.

    x shares at least 1 + min(p - f) prefix shingles with a like y, the least over both of prefix length p less
    f = size - c + 1; p - f is LEAST + size div SHARE or more, and the size of y is at least 0.8 that of x.
    """
    shared = repeated(prefixes(docs)).groupBy("member").agg(F.count(F.lit(1)).alias("shared"))
    enough = f"n < {FULL} or shared > {LEAST} + (4 * n div 5) div {SHARE}"
    return named.join(shared, "member").filter(enough).drop("shared")


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """member, n, tokens of the sets ``wanted`` (doc_id of a row of ``docs`` that has it, member)."""
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")

    @lean
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), LEAN):
                hashes, at = shingle_sets(block)
                names = signed(set_names(hashes, at))
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(at)), pa.array([raw[8 * at[i] : 8 * at[i + 1]] for i in range(len(block))], pa.binary())], ["member", "n", "tokens"])

    found = rows.mapInArrow(run, "member long, n long, tokens binary").join(wanted.select("member"), "member", "left_semi")
    return keep(found.dropDuplicates(["member"]), "sets", free=True)


def _tokens(batches):
    """key, member of every shingle of a batch of sets."""
    for batch in batches:
        raw = batch.column("tokens")
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in raw]) if len(batch) else np.zeros(0, np.int64)
        member = np.repeat(batch.column("member").to_numpy(), batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(member)], ["key", "member"])


def _counts(batches):
    """key, sets: how many sets of each batch have a shingle."""
    for batch in _tokens(batches):
        keys, sets = np.unique(batch.column("key").to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets)], ["key", "sets"])


def _sums(batches):
    """The counts of all batches of a partition, of shingles that two sets or more have."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches]
    if not parts:
        return
    key, sets = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(key, kind="stable")
    key, sets = key[order], sets[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    total = np.add.reduceat(sets, first) if len(first) else sets
    again = total > 1
    yield pa.RecordBatch.from_arrays([pa.array(key[first][again]), pa.array(total[again])], ["key", "sets"])


def frequency_prefixes(sets: DataFrame) -> DataFrame:
    """key, member, n, length (of the member's prefix): the shingles that other sets have too, of each prefix of the
    order by frequency. A set that has the whole of its least prefix for itself is like no other, and has no row."""
    sets = sets.select("member", "n", "tokens")
    counts = sets.mapInArrow(lean(_counts), "key long, sets long").repartition("key").mapInArrow(lean(_sums), "key long, sets long")
    rows = sets.mapInArrow(lean(_tokens), "key long, member long").join(counts, "key").join(sets.select("member", "n"), "member")
    own = Window.partitionBy("member")
    rows = rows.withColumns({"at": F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("sets", "key")), "least": F.expr("n - (4 * n + 4) div 5 + 1")})
    rows = rows.withColumn("cost", F.sum(F.when(F.col("at") <= F.col("least"), F.col("sets") - 1)).over(own)).filter("cost is not null")
    length = F.least("n", F.col("least") + F.floor(F.log2(1 + F.col("cost") / CHEAP)))
    return rows.withColumn("length", length).filter("at <= length").select("key", "member", "n", "length")


def needed(a: str, b: str) -> Column:
    """Prefix shingles that the sets of the structs ``a`` and ``b`` (n, length) share at least, if alike."""
    common = F.expr(f"(4 * ({a}.n + {b}.n) + 8) div 9")
    return 1 + F.least(*[F.col(f"{x}.length") - F.col(f"{x}.n") + common - 1 for x in (a, b)])


def matching(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) of like sizes that share as many prefix shingles as they must. ``heads``: member, n, length,
    keys (its prefix)."""
    x, y = (heads.select(F.col("member").alias(m), F.struct("n", "length", "keys").alias(s)) for m, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").filter("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
    return both.filter(F.size(F.array_intersect("x.keys", "y.keys")) >= needed("x", "y")).select("a", "b")


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others) without its text: n_shingles, member (a name of its
    set), component (a name of its group of sets that links join) and component_id: the least doc_id of that group.
    Links: Jaccard similarity 0.8 or more of the sets of 5-word shingles.

    A text of fewer words is one shingle; an empty or null one has no set, is linked with nothing and is its own
    component_id. Rows that repeat count as equal texts, and rows that share a doc_id but not the text as documents
    of their own. Rows without doc_id link others, but are the component_id of none.
    """
    docs = without(docs, "n_shingles", "member", "component", "component_id")
    names = keep(classes(docs), "classes")
    named = names.filter("n_shingles > 0").groupBy("member").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    docs = docs.select("doc_id", "text")
    wanted = keep(candidates(docs, named), "candidates", free=True)
    sets = set_table(docs, wanted)
    prefix = keep(frequency_prefixes(sets), "prefixes", free=True)
    heads = prefix.groupBy("member", "n", "length").agg(F.collect_list("key").alias("keys"))
    found = L.linked(prefix.select("key", "member"), sets, FEW, check=lambda pairs: matching(pairs, heads))
    groups = keep(components(found), "components", free=True)
    out = names.join(groups.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "member")))
    least_id = out.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(least_id, "component", "left").select(*[f"`{c}`" for c in names.columns], "component", F.coalesce("component_id", "doc_id").alias("component_id"))
