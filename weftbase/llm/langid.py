"""Language identification by prediction by partial matching (PPM).

Per language, a context tree of the last ``ORDER`` bytes holds how often each byte followed each context.
The statistics are frozen after training. The code length of a byte is that of PPM with escape method C
and full exclusion: the longest context that the tree knows codes the byte with count / (total + distinct);
a byte new to it costs an escape of distinct / (total + distinct) and is coded by the next shorter context
without the bytes just ruled out, down to a uniform code over what is left of the 256 bytes. A text's
language is the one whose tree codes all its bytes shortest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftbase.llm.scratch import without
from weftbase.llm.textbatch import BLOCK, LEAN, LOWER, Block, blocks, lean

ORDER = 3
PAD = 10
_added = StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")


def grams(block: Block) -> np.ndarray:
    """For each byte, its three predecessors within the document and itself as one 32-bit number."""
    data = LOWER[block.data]
    out = data.astype(np.uint32)
    begin, end = block.starts[:-1], block.starts[1:]
    for k in range(1, ORDER + 1):
        back = np.full(len(data), PAD, np.uint8)
        back[k:] = data[:-k] if len(data) > k else back[k:]
        for j in range(k):
            at = begin + j
            back[at[at < end]] = PAD
        out |= back.astype(np.uint32) << np.uint32(8 * k)
    return out


class Tree:
    """The context tree of one language, from the counts of its 4-byte sequences."""

    def __init__(self, gram: np.ndarray, count: np.ndarray) -> None:
        self.levels = []
        excluded = None
        for k in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else np.uint32(0xFFFFFFFF)
            key, at = np.unique(gram & mask, return_inverse=True)
            n = np.bincount(at, count).astype(np.float64)
            context, first = np.unique(key >> np.uint32(8), return_index=True)
            total = np.add.reduceat(n, first)
            distinct = np.diff(np.append(first, len(key))).astype(np.float64)
            if excluded is not None:
                longer_key, longer_first = excluded
                seen = n[np.searchsorted(key, longer_key & mask)]
                self.levels[-1]["ruled_out"] = np.add.reduceat(seen, longer_first)
            self.levels.append({"key": key, "n": n, "context": context, "total": total, "distinct": distinct})
            excluded = (key, first)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each sequence after the bytes before it."""
        bits = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        out_n, out_d = np.zeros(len(gram)), np.zeros(len(gram))
        for k, level in zip(range(ORDER, -1, -1), self.levels, strict=True):
            mask = np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else np.uint32(0xFFFFFFFF)
            key = gram & mask
            at = np.minimum(np.searchsorted(level["context"], key >> np.uint32(8)), len(level["context"]) - 1)
            known = level["context"][at] == key >> np.uint32(8)
            where = np.minimum(np.searchsorted(level["key"], key), len(level["key"]) - 1)
            found = open_ & (level["key"][where] == key)
            total, distinct = level["total"][at] - out_n, level["distinct"][at] - out_d
            bits[found] += np.log2((total + distinct)[found]) - np.log2(level["n"][where[found]])
            escapes = open_ & known & ~found & (distinct > 0)
            bits[escapes] += np.log2((total + distinct)[escapes]) - np.log2(distinct[escapes])
            open_ &= ~found
            if k:
                out_n = np.where(known, level["ruled_out"][at], 0.0)
                out_d = np.where(known, level["distinct"][at], 0.0)
            else:
                bits[open_] += np.log2(max(256 - level["distinct"][0], 1))
        return bits


class Model:
    """Trees of all languages; code lengths of every sequence seen in training are tabled.

    ``slots`` is an open-addressing hash table from a sequence to its column in ``bits``.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.languages]
        seen = np.unique(np.concatenate([counts[x][0] for x in self.languages]))
        self.bits = np.stack([t.code_lengths(seen) for t in self.trees])
        self.shift = 32 - max(4, int(np.ceil(np.log2(4 * len(seen)))))
        self.keys = np.zeros(1 << (32 - self.shift), np.uint32)
        self.slots = np.full(len(self.keys), -1, np.int32)
        left, at = np.arange(len(seen)), self._home(seen)
        while len(left):
            free = self.slots[at] < 0
            taken, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slots[taken] = left[put]
            self.keys[taken] = seen[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint32(2654435769)) >> np.uint32(self.shift)).astype(np.int64)

    def score(self, block: Block) -> np.ndarray:
        """Code length in bits of each document in each language: documents x languages."""
        out = np.zeros((len(block), len(self.languages)))
        for begin in range(0, len(block.data), BLOCK):
            gram = grams(block) if begin == 0 and len(block.data) <= BLOCK else self._long(block, begin)
            at = self._home(gram)
            column = self.slots[at]
            wrong = np.flatnonzero((self.keys[at] != gram) & (column >= 0))
            while len(wrong):
                at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
                column[wrong] = self.slots[at[wrong]]
                wrong = wrong[(self.keys[at[wrong]] != gram[wrong]) & (column[wrong] >= 0)]
            new = np.flatnonzero(column < 0)
            some, back = np.unique(gram[new], return_inverse=True) if len(new) else (gram[:0], None)
            starts = block.starts - begin
            filled = np.flatnonzero((starts[1:] > 0) & (starts[:-1] < len(gram)) & (np.diff(starts) > 0))
            for k, tree in enumerate(self.trees):
                bits = self.bits[k][column]
                if len(new):
                    bits[new] = tree.code_lengths(some)[back]
                out[filled, k] += np.add.reduceat(bits, np.maximum(starts[filled], 0))
        return out

    @staticmethod
    def _long(block: Block, begin: int) -> np.ndarray:
        """A stretch of a text that is longer than a block, after the bytes that precede it."""
        ahead = min(begin, ORDER)
        part = block.data[begin - ahead : begin + BLOCK]
        return grams(Block(0, part, np.array([0, len(part)])))[ahead:]


def train(docs: DataFrame, sample_bytes: int = 4_000_000) -> Model | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) with a lang; None if there is nothing to learn from.

    ``sample_bytes`` bounds the text taken of each language: where a language has more, a hash of the row
    picks the share that comes to this much. So the model has at most that many sequences a language.
    """
    rows = docs.filter("lang is not null and text is not null and text != ''").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["bytes"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not totals:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == F.lit(k), F.lit(min(1.0, sample_bytes / v))) for k, v in totals.items()])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * F.lit(float(1 << 20)))

    @lean
    def count(batches):
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("lang"), lang))
                for block in blocks(own.column("text"), LEAN):
                    gram, n = np.unique(grams(block), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    table = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model({k: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for k, g in table.groupby("lang")}) if len(table) else None


def identify(docs: DataFrame, model: Model | Broadcast | None, keep_text: bool = True) -> DataFrame:
    """``docs`` (any columns, text among them) with lang_pred, score and bits_per_byte.

    score is the share of the predicted language when each weighs 2 ** -(its code length). A text that is
    null or has no letter gets ``und`` and score 0. Of languages with equal code lengths the first by name is taken;
    equal texts get equal results. Only the text is looked at, and without ``keep_text`` it does not come back from
    the tasks. A model that is used more than once can come as a broadcast variable.
    """
    docs = without(docs, "lang_pred", "score", "bits_per_byte", "_letters")
    rest = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    if model is None:
        return docs.select(*[f"`{f.name}`" for f in rest]).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rest, *_added.fields])

    @lean
    def predict(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            parts = [model.score(block) for block in blocks(batch.column("text"), LEAN)]
            bits = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
            best = bits.argmin(1) if len(bits) else np.zeros(0, int)
            least = bits.min(1) if len(bits) else np.zeros(0)
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1) if len(bits) else least
            size = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            sure = batch.column("_letters").fill_null(False).to_numpy(zero_copy_only=False)
            made = [pa.array(names[np.where(sure, best, -1)], pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(least / np.maximum(size, 1), mask=~sure)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *made], schema.names)

    return docs.withColumn("_letters", F.col("text").rlike(r"\p{L}")).mapInArrow(predict, schema)
