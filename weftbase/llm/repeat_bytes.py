"""Exact removal of repeated byte strings of ``LENGTH`` bytes or more.

Any two equal strings of 100 bytes share their least-hashed 48-byte seed (the minimum over the 53 seeds
within the string), so strings need comparing only where a document's seed also occurs elsewhere. The
strings that share one least seed in a row form a block. A block whose bytes stand earlier as a block is
repeated as a whole; what is left (first blocks whose seed comes with other blocks too: the edges of
repeats) is compared string by string.

Each task settles what it can within its own batch, so a passage in a third of all documents sends one row
per batch. Blocks of one seed meet in groups of bounded size; of a seed with more than one group, each
group's first strings are compared once more by a grouping.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftbase.llm.repeats import ROUTED, repeated, routed
from weftbase.llm.scratch import keep
from weftbase.llm.textbatch import Block, blocks, mix64, powers, prefix_hash, span_hash, BASE_INVERSE

LENGTH, SEED = 100, 48
SEEDS = LENGTH - SEED + 1
#: About so many different blocks of one seed are compared in one group.
FEW = 512
HIGH = np.uint64(0xFFFFFFFF00000000)


def _windows(prefix: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each of the first ``n`` positions."""
    return mix64((prefix[size : size + n] - prefix[:n]) * powers(BASE_INVERSE, n))


def seed_blocks(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of strings with the same least seed: (key, document, first and last string's start, prefix hash).

    Positions are within the block's data. The least seed is that of the least upper hash half, the first
    of equals, which depends on nothing but the string."""
    size = len(block.data)
    prefix = prefix_hash(block.data)
    n = size - SEED + 1
    room = size - LENGTH + 1
    if room <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, prefix
    hashes = _windows(prefix, n, SEED)
    least = (hashes & HIGH) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= SEEDS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < SEEDS:
        least = np.minimum(least[: room], least[SEEDS - span : SEEDS - span + room])
    at = (least & ~HIGH).astype(np.int64)
    lengths = np.diff(block.starts)
    last = block.starts[:-1] + lengths - LENGTH
    fits = np.zeros(room + 1, np.int64)
    long_ = lengths >= LENGTH
    np.add.at(fits, block.starts[:-1][long_], 1)
    np.add.at(fits, last[long_] + 1, -1)
    starts = np.flatnonzero(np.cumsum(fits[:room]) > 0)
    anchor = at[starts]
    owner = block.owner(starts)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(starts)) - 1
    return hashes[anchor[first]], owner[first], starts[first], starts[end], prefix


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def seeds(docs: DataFrame) -> DataFrame:
    """Exchange rows: key is a seed, member a doc_id. A seed that a document has in two blocks repeats."""

    def run(batches):
        for batch in batches:
            ids = _doc_ids(batch)
            keys, docs_ = [], []
            for block in blocks(batch.column("text")):
                key, owner, *_ = seed_blocks(block)
                keys.append(key)
                docs_.append(ids[block.first + owner])
            if keys:
                key = np.concatenate(keys)
                ordered = np.sort(key)
                yield routed(key, np.concatenate(docs_).view(np.uint64), np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))

    return docs.mapInArrow(run, ROUTED)


BLOCKS = "route long, key long, bytes long, doc_id long, first long, last long, gone boolean"
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _settle(key, body, doc, first, last):
    """Order and mask of what is settled: rows in order of block and place, and which are not the first place
    of their block."""
    order = np.lexsort((first, doc, body, key))
    key, body, doc, first = key[order], body[order], doc[order], first[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (body[1:] != body[:-1])
    start = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    later = (doc != doc[start][which]) | (first != first[start][which]) if len(start) else head
    return order, head, later


def block_rows(rows: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, text, keys) whose seed is among the document's keys: key, bytes (hash of
    the block), doc_id, first, last (starts of its strings within the text), gone where an equal block comes
    earlier in the same batch."""

    def run(batches):
        for batch in batches:
            ids = _doc_ids(batch)
            wanted = batch.column("keys")
            parts = []
            for block in blocks(batch.column("text")):
                key, owner, first, last, prefix = seed_blocks(block)
                use = np.zeros(len(key), bool)
                upto = np.searchsorted(owner, np.arange(len(block) + 1))
                for i in range(len(block)):
                    own = wanted[block.first + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    use[upto[i] : upto[i + 1]] = np.isin(key[upto[i] : upto[i + 1]], own)
                key, owner, first, last = key[use], owner[use], first[use], last[use]
                body = span_hash(prefix_hash(block.data, 1), first, last + LENGTH) + (last - first).astype(np.uint64)
                parts.append((key, body, ids[block.first + owner], first - block.starts[owner], last - block.starts[owner]))
            if not parts:
                continue
            columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            order, head, later = _settle(*columns)
            key, body, doc, first, last = (c[order] for c in columns)
            use = head | later
            gone = (later & ~head)[use]
            key, body, doc, first, last = (c[use] for c in (key, body, doc, first, last))
            route = np.where(gone, mix64(doc.view(np.uint64) ^ mix64(first.view(np.uint64))), mix64(key ^ mix64(body)))
            arrays = (route.view(np.int64), key.view(np.int64), body.view(np.int64), doc, first, last, gone)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], _BLOCK_NAMES)

    return rows.select("doc_id", "text", "keys").mapInArrow(run, BLOCKS)


def _settled(batches):
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not parts:
        return
    _, key, body, doc, first, last, gone = (np.concatenate([p[i] for p in parts]) for i in range(7))
    open_ = ~gone.astype(bool)
    order, head, later = _settle(key[open_], body[open_], doc[open_], first[open_], last[open_])
    use = head | later
    picked = np.flatnonzero(open_)[order][use]
    rows = np.concatenate([np.flatnonzero(~open_), picked])
    off = np.concatenate([np.ones((~open_).sum(), bool), (later & ~head)[use]])
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[rows], doc[rows], first[rows], last[rows], off)], ["key", "doc_id", "first", "last", "gone"])


def bodies(rows: DataFrame) -> DataFrame:
    """The bytes of blocks of documents (doc_id, text, spans: array of key, first, last, groups)."""

    def run(batches):
        for batch in batches:
            ids = _doc_ids(batch)
            spans = batch.column("spans")
            for block in blocks(batch.column("text")):
                raw = block.data.tobytes()
                out = []
                for i in range(len(block)):
                    own = spans[block.first + i].values
                    begin = int(block.starts[i])
                    for key, first, last, groups in zip(*[own.field(c).to_pylist() for c in ("key", "first", "last", "groups")], strict=True):
                        out.append((key, int(ids[block.first + i]), first, groups, raw[begin + first : begin + last + LENGTH]))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "first", "groups", "body"])

    return rows.mapInArrow(run, "key long, doc_id long, first long, groups long, body binary")


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Two hashes, doc_id and start of every string of a batch of bodies, and whether its seed has more groups."""
    column = batch.column("body").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    at = at - at[:1] if len(column) else np.zeros(1, np.int64)
    n = np.maximum(np.diff(at) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][row] + off
    hashes = [span_hash(prefix_hash(data, seed), start, start + LENGTH) for seed in (0, 1)]
    return *hashes, batch.column("doc_id").to_numpy()[row], batch.column("first").to_numpy()[row] + off, batch.column("groups").to_numpy()[row] > 1


COMPARED = "doc_id long, start long, end long, h long, g long"


def _compare(batches):
    """Strings of the bodies of a partition that stand earlier among them, as ranges of bytes; and, with their
    hashes, the first ones of seeds that have more groups."""
    parts = [_strings(b) for b in batches]
    if not parts:
        return
    h, g, doc, at, more = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order, head, later = _settle(h, g, doc, at, None)
    gone, kept = order[later & ~head], order[head]
    kept = kept[more[kept]]
    gone = gone[np.lexsort((at[gone], doc[gone]))]
    new = np.ones(len(gone), bool)
    new[1:] = (doc[gone][1:] != doc[gone][:-1]) | (at[gone][1:] > at[gone][:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(gone))[: len(first)] - 1
    none = pa.nulls(len(first), pa.int64())
    names = [c.split()[0] for c in COMPARED.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(doc[gone][first]), pa.array(at[gone][first]), pa.array(at[gone][end] + LENGTH), none, none], names)
    yield pa.RecordBatch.from_arrays([pa.array(doc[kept]), pa.array(at[kept]), pa.array(at[kept] + LENGTH), pa.array(h[kept].view(np.int64)), pa.array(g[kept].view(np.int64))], names)


def cut(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, as text) of documents
    (doc_id, text, gone: array of byte ranges start..end)."""

    def run(batches):
        for batch in batches:
            gone = batch.column("gone")
            out = []
            for block in blocks(batch.column("text")):
                for i in range(len(block)):
                    data = block.data[block.starts[i] : block.starts[i + 1]]
                    own = gone[block.first + i].values
                    level = np.zeros(len(data) + 1, np.int64)
                    np.add.at(level, own.field("start").to_numpy(), 1)
                    np.add.at(level, own.field("end").to_numpy(), -1)
                    off = np.cumsum(level[:-1]) > 0
                    kept = data[~off].tobytes()
                    out.append((len(data), int(off.sum()), int(off[0]) + int((off[1:] & ~off[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, candidates): byte ranges to remove (doc_id, start, end; they can overlap), and the documents
    (doc_id, text) that can hold any."""
    shared = keep(repeated(seeds(docs)).groupBy("member").agg(F.collect_list("key").alias("keys")), "shared", free=True)
    candidates = keep(docs.join(shared.withColumnRenamed("member", "doc_id"), "doc_id"), "candidates", free=True)
    settled = keep(block_rows(candidates).repartition("route").mapInArrow(_settled, "key long, doc_id long, first long, last long, gone boolean"), "settled", free=True)
    whole = settled.filter("gone").select("doc_id", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    kinds = settled.filter("not gone")
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / FEW).alias("groups"))
    edges = kinds.join(mixed, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "last", "groups")).alias("spans"))
    found = keep(bodies(candidates.join(edges, "doc_id").select("doc_id", "text", "spans")), "bodies", free=True)
    group = F.pmod(F.xxhash64("doc_id"), F.col("groups"))
    compared = keep(found.repartition("key", group).mapInArrow(_compare, COMPARED), "compared", free=True)
    strings = compared.filter("h is not null")
    place = F.struct("doc_id", "start")
    early = strings.groupBy("h", "g").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    across = strings.join(early, ["h", "g"]).filter(place > F.col("place")).select("doc_id", "start", "end")
    return whole.union(compared.filter("h is null").select("doc_id", "start", "end")).union(across), candidates.select("doc_id", "text")


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, own): ``docs`` with member, and one row (doc_id, text) a member, under its number. A member is a
    text of a doc_id; its number is the doc_id unless one comes more than once, else the place of doc_id and the
    text's hash in order, counted by ranges."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("member", F.col("doc_id")), docs
    rows = docs.withColumn("sha", F.sha2("text", 256))
    places = keep(rows.select("doc_id", "sha").distinct().repartitionByRange("doc_id", "sha").withColumn("range", F.spark_partition_id()), "places")
    sizes = places.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "sha"))
    members = places.join(sizes.select("range", before), "range").select("doc_id", "sha", (F.col("before") + nth).alias("member"))
    out = keep(rows.join(members, ["doc_id", "sha"]).select("doc_id", "text", "member"), "members", free=True)
    return out, keep(out.select(F.col("member").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "own", free=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a 100-byte string that also starts earlier: in a smaller doc_id, or
    earlier in the same document. Null texts count as empty; shorter texts lose nothing. Equal rows are one
    document and get one result; rows that share a doc_id only are documents of their own, in the order of
    their texts' SHA-256. A null doc_id sorts first.
    """
    lowest = F.lit(np.iinfo(np.int64).min)
    rows, own = _members(docs.select(F.coalesce(F.col("doc_id"), lowest).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    gone, candidates = repeated_spans(own)
    by_doc = keep(gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone", free=True)
    changed = cut(candidates.join(by_doc, "doc_id").select("doc_id", "text", "gone")).drop("kept", "n_bytes").withColumnRenamed("doc_id", "member")
    plain = rows.select("doc_id", "member", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = plain.join(changed, "member", "left")
    return out.select(
        F.nullif(F.col("doc_id"), lowest).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )
