"""Paragraph dedup: MinHash bands propose pairs, exact Jaccard similarity decides, components are removed.

A paragraph is a line of at least ``MIN_WORDS`` words, or shorter lines in a row that have so many together (text
wrapped at some width: where lines end within it does not matter). Its set is that of its 5-word shingles, lower-cased.
Bands and rows are tuned for recall. Equal sets are one member; colliding members are compared with pivots
first, then pair by pair wherever a band still holds two components, in tiles where its members are many.

What stands within longer paragraphs, or across the ends of paragraphs, is found by bands of another kind, seeds: runs of
``SEED`` words of a document chosen by their hashes alone, so that every two equal runs of ``PASSAGE`` words have one in
common wherever they stand. Documents that collide in a seed share its words; no further check is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftbase.llm import links as L
from weftbase.llm.components import components
from weftbase.llm.jaccard_join import set_names, shingle_sets
from weftbase.llm.repeats import ROUTED, repeated, routed
from weftbase.llm.scratch import keep
from weftbase.llm.textbatch import BASE, Block, blocks, mix64, shingle_hashes, signed, word_hashes, words

MIN_WORDS = 20
SIMILARITY = 0.8
#: Groups of more members are compared in tiles.
FEW = 128
PASSAGE, SEED = 50, 25


def tune(similarity: float, recall: float, bands: int = 12) -> tuple[int, int]:
    """(bands, rows): as many rows a band as still give ``recall`` at ``similarity``."""
    rows = 1
    while 1 - (1 - similarity ** (rows + 1)) ** bands >= recall:
        rows += 1
    return bands, rows


def lines(block: Block) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block cut into paragraphs as well: (paragraphs, document of each, number of its first line within its
    document). Short lines that follow each other, no blank one between, are one paragraph: text that is wrapped."""
    begin = np.unique(np.concatenate([block.starts[:-1], np.flatnonzero(block.data == 10) + 1]))
    begin = begin[begin < len(block.data)]
    owner = block.owner(begin)
    first = np.searchsorted(owner, np.arange(len(block)))
    number = np.arange(len(begin)) - first[owner]
    n = words(Block(0, block.data, np.append(begin, len(block.data)))).counts
    wrapped = (n > 0) & (n < MIN_WORDS)
    head = np.ones(len(begin), bool)
    head[1:] = ~(wrapped[1:] & wrapped[:-1] & (owner[1:] == owner[:-1]))
    return Block(0, block.data, np.append(begin[head], len(block.data))), owner[head], number[head]


def _sets(block: Block):
    cut, owner, number = lines(block)
    n_words = words(cut).counts
    hashes, at = shingle_sets(cut)
    return n_words, owner, number, hashes, at, set_names(hashes, at)


def paragraph_table(docs: DataFrame) -> DataFrame:
    """doc_id, doc (name of the row), paragraph (number of its first line, from 0), n_words, member (name of its set) of
    every paragraph."""
    schema = StructType([docs.schema["doc_id"]]).add("doc", "long").add("paragraph", "long").add("n_words", "long").add("member", "long")

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                n, owner, number, _, _, names = _sets(block)
                use = n >= MIN_WORDS
                own = pa.array(block.first + owner[use])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("doc").take(own), pa.array(number[use]), pa.array(n[use]), pa.array(signed(names[use]))], schema.names)

    return _named(docs).mapInArrow(run, schema)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, a hash of both."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))


def bands(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """Exchange rows: key is a band of a paragraph's MinHash, member its set."""
    factors = np.random.default_rng(5).integers(1, 1 << 63, n_bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                n, _, _, hashes, at, names = _sets(block)
                long_ = np.flatnonzero(n >= MIN_WORDS)
                _, one = np.unique(names[long_], return_index=True)
                which = long_[one]
                if not len(which):
                    continue
                size = at[which + 1] - at[which]
                ends = np.cumsum(size)
                own = hashes[np.arange(ends[-1]) + np.repeat(at[which] - (ends - size), size)]
                keys = np.zeros((n_bands, len(which)), np.uint64)
                for b in range(n_bands):
                    keys[b] = b + 1
                    for r in range(rows):
                        keys[b] = mix64(keys[b] * np.uint64(BASE) + np.minimum.reduceat((own * factors[b * rows + r]) ^ (own >> np.uint64(29)), ends - size))
                yield routed(keys.ravel(), np.tile(names[which], n_bands))

    return docs.select("text").mapInArrow(run, ROUTED)


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """member, n, tokens of the paragraphs named in ``wanted`` (doc_id of one that has it, member). A task gets the
    names with the text, so that no other paragraph's set travels; without doc_id, the names are joined after."""

    def run(batches):
        for batch in batches:
            column = batch.column("members")
            listed, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy())])
            for block in blocks(batch.column("text")):
                n, owner, _, hashes, at, names = _sets(block)
                use = n >= MIN_WORDS
                for i in range(len(block)):
                    own = listed[ends[block.first + i] : ends[block.first + i + 1]]
                    if len(own):
                        low, high = np.searchsorted(owner, [i, i + 1])
                        use[low:high] &= np.isin(signed(names[low:high]), own)
                raw, use = hashes.tobytes(), np.flatnonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[use])), pa.array(np.diff(at)[use]), pa.array([raw[8 * at[i] : 8 * at[i + 1]] for i in use], pa.binary())], ["member", "n", "tokens"])

    shape = "member long, n long, tokens binary"
    lists = wanted.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("member").alias("members"))
    found = docs.join(lists, docs["doc_id"] == lists["id"]).select("text", "members").mapInArrow(run, shape)
    loose = docs.filter("doc_id is null").select("text", F.array().cast("array<long>").alias("members")).mapInArrow(run, shape)
    loose = loose.join(wanted.filter("doc_id is null").select("member"), "member", "left_semi")
    return keep(found.union(loose).dropDuplicates(["member"]), "sets", free=True)


def repeated_paragraphs(docs: DataFrame, recall: float = 0.998) -> DataFrame:
    """One row per paragraph of ``docs`` (doc_id, text) that has a like: doc_id, paragraph, n_words,
    kept_doc_id and kept_paragraph (the first of its component by doc_id, then line), removed (whether it
    is another than that one). Likes: paragraphs of Jaccard similarity 0.8 or more, over any chain of them.

    Empty and null texts have no paragraph. Rows that repeat a doc_id, or have none (which sorts first), count as
    documents of their own; of equal first paragraphs one is kept.
    """
    docs = docs.select("doc_id", "text")
    return _repeated(docs, _numbered(docs), recall).drop("row", "doc")


def _numbered(docs: DataFrame) -> DataFrame:
    """``paragraph_table`` with a number of each row, written: it tells rows apart that are equal."""
    return keep(paragraph_table(docs).withColumn("row", F.monotonically_increasing_id()), "paragraphs")


def _repeated(docs: DataFrame, table: DataFrame, recall: float) -> DataFrame:
    keys = keep(repeated(bands(docs, *tune(SIMILARITY, recall))).select("key", "member").distinct(), "keys", free=True)
    members = keys.select("member").distinct()
    wanted = keep(table.join(members, "member", "left_semi").groupBy("member").agg(F.min("doc_id").alias("doc_id")), "wanted")
    sets = set_table(docs, wanted)
    sizes = keep(sets.select("member", "n"), "sizes")
    links = L.linked(keys, sets, FEW, rounds=1, check=lambda pairs: _like_sizes(pairs, sizes))
    groups = keep(components(links), "components", free=True)
    rows = table.join(groups.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "paragraph", "member", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = rows.join(keep(first.drop("n"), "first"), "component")
    return out.select("row", "doc", "doc_id", "paragraph", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.paragraph").alias("kept_paragraph"), (F.col("row") != F.col("first.row")).alias("removed"))


def _like_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are not too far apart in size to be alike."""
    x, y = (sizes.select(F.col("member").alias(m), F.col("n").alias(n)) for m, n in (("a", "na"), ("b", "nb")))
    return pairs.join(x, "a").join(y, "b").filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")).select("a", "b")


def seeds(hashes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the least of some ``width`` in a row of one owner."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = _slide(np.minimum, hashes, width)
    least[owner[:n] != owner[width - 1 :]] = 0
    least = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_slide(np.maximum, least, width) == hashes) & (hashes > 0))


def _slide(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` of every ``width`` in a row, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[:n], x[width - have : width - have + n])


def _seeds(block: Block) -> tuple[np.ndarray, ...]:
    """Of each seed of the documents of ``PASSAGE`` words or more: hash, document, word (from 0) of the document and of
    the paragraph it begins in, and the numbers of the paragraphs that it begins and ends in and, where it holds a whole
    one of ``MIN_WORDS`` words between (there is room for one), of that; else of the first again."""
    cut, _, number = lines(block)
    w, offsets = words(block), words(cut).offsets
    hashes, doc = shingle_hashes(word_hashes(block, w, fold=True), w, SEED)
    own = w.counts[doc] >= PASSAGE
    hashes, doc = mix64(hashes[own]), doc[own]
    at = seeds(hashes, doc, PASSAGE - SEED + 1)
    doc, place = doc[at], at - np.searchsorted(doc, doc[at])
    word = w.offsets[doc] + place
    first, last = (np.searchsorted(offsets, x, "right") - 1 for x in (word, word + SEED - 1))
    long_ = np.append(np.flatnonzero(np.diff(offsets) >= MIN_WORDS), len(cut))
    middle = long_[np.searchsorted(long_, first, "right")] if len(first) else first
    middle = np.where(middle < last, middle, first)
    return hashes[at], doc, place, word - offsets[first], number[first], number[last], number[middle]


def seed_keys(docs: DataFrame) -> DataFrame:
    """Exchange rows: key is a seed, member the paragraph of the document that it begins in, note its word of the document;
    doc_id, doc; begins (number of that paragraph, word within it), ends (numbers of the paragraphs it ends in and holds)."""

    def run(batches):
        for batch in batches:
            names = batch.column("doc").to_numpy().view(np.uint64)
            for block in blocks(batch.column("text")):
                hashes, doc, place, word, first, last, middle = _seeds(block)
                doc += block.first
                more = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "doc": batch.column("doc").take(pa.array(doc)), "begins": pa.array((first << 32) + word), "ends": pa.array((last << 32) + middle)}
                yield routed(hashes, mix64(names[doc] ^ mix64((first + 1).astype(np.uint64))), note=place, more=more)

    schema = StructType().add("route", "long").add("key", "long").add("member", "long").add("kind", "long").add(docs.schema["doc_id"])
    return _named(docs).mapInArrow(run, schema.add("doc", "long").add("begins", "long").add("ends", "long"))


def _passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per passage of a document that stands in another one too, or in two paragraphs of one: the columns of
    ``repeated_paragraphs`` and first_word (from 0, in the paragraph that the passage begins in). It can go on into
    the paragraphs that follow.

    Paragraphs that ``found`` (of ``_repeated``) removes are left out, and so is what reaches into them. Of the rest,
    every run of ``PASSAGE`` words or more that two documents have in common, up to the case of A-Z, is found, wherever
    lines end within it, and so is every one within two paragraphs of one document. Where a run comes again within a
    paragraph, the first place counts. A row spans the seeds found in it, which is ``SEED`` words at least; up to
    ``PASSAGE`` - ``SEED`` words at either end of a run can be missing. (Seeds of one run are at most ``PASSAGE`` -
    ``SEED`` + 1 words apart.)
    """
    high = lambda c: F.shiftright(c, 32)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    hits = keep(repeated(seed_keys(docs)).withColumnRenamed("key", "seed"), "hits", free=True)
    removed = keep(found.groupBy("doc", "paragraph").agg(F.every("removed").alias("gone")).filter("gone").withColumnRenamed("paragraph", "part"), "removed")
    parts = hits.withColumn("part", F.explode(F.array_distinct(F.array(high("begins"), high("ends"), low("ends"))))).join(removed, ["doc", "part"], "left")
    held = F.struct(F.col("note").alias("at"), "doc_id", "doc", high("begins").alias("paragraph"), low("begins").alias("word"), (high("begins") != high("ends")).alias("crosses"))
    rows = parts.groupBy("seed", "member").agg(F.min(held).alias("held"), F.count("gone").alias("gone")).filter("gone = 0")
    rows = keep(rows.select("seed", "held.*", F.when(F.col("held.crosses"), F.col("held.doc")).otherwise(F.col("member")).alias("where")), "seeds", free=True)
    first = rows.groupBy("seed").agg(F.min(F.struct("doc_id", "paragraph", "doc", "at")).alias("first"), F.min("where").alias("low"), F.max("where").alias("high"))
    rows = rows.join(keep(first.filter("low != high").select("seed", "first"), "first"), "seed")
    rows = rows.withColumn("own", (F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at")))
    one = ["doc_id", "doc", "first.doc_id", "first.doc", "own"]
    ordered = Window.partitionBy(*one).orderBy("at")
    rows = rows.withColumn("fresh", F.coalesce(F.col("at") > F.lag("at").over(ordered) + PASSAGE - SEED + 1, F.lit(True)).cast("long"))
    rows = rows.withColumn("run", F.sum("fresh").over(ordered))
    out = rows.groupBy("doc_id", "doc", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.doc").alias("kept_doc"), "own", "run")
    out = out.agg(F.min(F.struct("at", "paragraph", "word", F.col("first.paragraph").alias("kept_paragraph"))).alias("begin"), F.max("at").alias("last"))
    return out.select("doc_id", "begin.paragraph", (F.col("last") + SEED - F.col("begin.at")).alias("n_words"), "kept_doc_id", "begin.kept_paragraph", (~F.col("own")).alias("removed"), F.col("begin.word").alias("first_word"))


def repeated_text(docs: DataFrame, recall: float = 0.998) -> DataFrame:
    """``repeated_paragraphs`` (first_word null), and one row per passage of the text it leaves that stands elsewhere
    too, with first_word (from 0, in its paragraph): every run of ``PASSAGE`` words or more that two documents, or two
    paragraphs of one, have in common. Of rows that repeat a doc_id and a text, equal passages are one."""
    docs = docs.select("doc_id", "text")
    whole = keep(_repeated(docs, _numbered(docs), recall), "whole", free=True)
    return whole.drop("row", "doc").withColumn("first_word", F.lit(None).cast("long")).unionByName(_passages(docs, whole))
