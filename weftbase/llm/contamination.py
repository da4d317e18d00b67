"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The benchmark's windows of ``WINDOW`` words are the test strings: ``" w1 w2 ... w10 "``. Texts are brought to the
same form, so that an occurrence is one of bytes. Windows of like length share a table: the last ``GRAM`` bytes of
the shortest one's length are looked up in a shift table, which mostly tells that no window can stand here and how
far to go on; where it does not, the bucket of these bytes and of the first ones selects windows, whose bytes are
then compared. Stretches of a text advance together, one step of all at a time.

Benchmarks of any size: their windows are dealt to parts of at most ``PART`` bytes, and each part is one pass over
the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weftbase.llm.scratch import keep, without
from weftbase.llm.textbatch import LOWER, Block, blocks, mix64, ragged

WINDOW = 10
#: Words of an item's piece; longer items are cut into pieces that share WINDOW - 1 words.
PIECE = 2000
#: Bytes of the benchmark that go to each task at once.
PART = 8_000_000
#: Bytes that the shift tables look at, for windows of at least so many bytes.
CLASSES = ((24, 6), (8, 4), (3, 2))
SLOTS = 20
#: Bytes of a stretch of text, and pairs compared at once.
STRETCH = 512
PAIRS = 500_000

_word = np.zeros(256, bool)
_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null: null."""
    return F.regexp_extract_all(F.translate(text, UPPER, SMALL), F.lit(f"({WORD})"), F.lit(1))


def _loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, the first byte lowest; ``data`` ends in 8 spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))


def _slot(gram: np.ndarray) -> np.ndarray:
    return (mix64(gram) >> np.uint64(64 - SLOTS)).astype(np.int64)


@dataclass
class Table:
    """Windows of at least ``least`` bytes: shifts by hashed gram, and buckets by last and first bytes."""

    least: int
    gram: int
    shift: np.ndarray
    bucket: np.ndarray
    window: np.ndarray


class Windows:
    """The distinct windows of texts of a benchmark, and the items of each."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        """``rows``: item and its words, joined by spaces."""
        self.items = sorted({item for item, _ in rows}, key=str.encode)
        number = {x: i for i, x in enumerate(self.items)}
        self.data = np.frombuffer(b"".join(b" " + t.encode() + b" " for _, t in rows) + b"\0" * 8, np.uint8)
        size = np.array([len(t.encode()) + 2 for _, t in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])
        blank = np.flatnonzero(self.data[:-8] == 32)
        first = np.searchsorted(blank, starts)
        n = np.diff(first) - 1
        wide = np.minimum(n, WINDOW)
        begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n - wide + 1)[:-1]]), n - wide + 1) + np.arange(int((n - wide + 1).sum()))
        row = np.repeat(np.arange(len(rows)), n - wide + 1)
        start, end = blank[begin], blank[begin + wide[row]] + 1
        texts = [self.data[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        of, one, back = np.unique(np.array(texts, object), return_index=True, return_inverse=True)
        self.start, self.size, self.words = start[one], (end - start)[one], wide[row[one]]
        both = np.unique(back.astype(np.int64) * len(self.items) + np.array([number[x] for x, _ in rows], np.int64)[row])
        self.item = both % len(self.items)
        self.item_at = np.searchsorted(both // len(self.items), np.arange(len(of) + 1))
        self.loads = _loads(self.data)
        self.tables, rest = [], np.arange(len(of))
        for low, gram in CLASSES:
            own = rest[self.size[rest] >= low]
            rest = rest[self.size[rest] < low]
            if len(own):
                self.tables.append(self._table(own, gram))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "loads"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.loads = _loads(self.data)

    def _grams(self, at: np.ndarray, gram: int) -> np.ndarray:
        return self.loads[at] & np.uint64((1 << 8 * gram) - 1)

    def _table(self, own: np.ndarray, gram: int) -> Table:
        least = int(self.size[own].min())
        shift = np.full(1 << SLOTS, least - gram + 1, np.int32)
        for end in range(gram, least + 1):
            np.minimum.at(shift, _slot(self._grams(self.start[own] + end - gram, gram)), least - end)
        key = self._key(self.loads, self.start[own], least, gram)
        order = np.argsort(key, kind="stable")
        return Table(least, gram, shift, key[order], own[order])

    @staticmethod
    def _key(loads: np.ndarray, at: np.ndarray, least: int, gram: int) -> np.ndarray:
        """The bucket of a window that starts here: its first bytes, and the last of ``least``."""
        low = np.uint64((1 << 8 * min(least, 8)) - 1)
        return mix64(mix64(loads[at] & low) + (loads[at + least - gram] & np.uint64((1 << 8 * gram) - 1)))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur in ``data`` (which ends in 8 spare bytes): start positions, and which windows."""
        loads = _loads(data)
        found = [self._scan(loads, len(data) - 8, t) for t in self.tables]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))

    def _scan(self, loads: np.ndarray, n: int, t: Table) -> tuple[np.ndarray, np.ndarray]:
        mask, back = np.uint64((1 << 8 * t.gram) - 1), t.least - t.gram
        at = np.arange(0, max(n - t.least + 1, 0), STRETCH)
        stop = np.minimum(at + STRETCH, n - t.least + 1)
        stood = []
        while len(at):
            step = t.shift[_slot(loads[at + back] & mask)]
            if (here := step == 0).any():
                stood.append(at[here])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        place = np.concatenate(stood) if stood else np.zeros(0, np.int64)
        key = self._key(loads, place, t.least, t.gram)
        low, high = np.searchsorted(t.bucket, key, "left"), np.searchsorted(t.bucket, key, "right")
        place, low, many = place[high > low], low[high > low], (high - low)[high > low]
        out_at, out_window = [], []
        upto, begin = np.cumsum(many), 0
        while begin < len(place):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
            size = many[begin:end]
            where = np.repeat(place[begin:end], size)
            window = t.window[np.arange(len(where)) + np.repeat(low[begin:end] - np.cumsum(size) + size, size)]
            same = self._same(loads, n, where, window)
            out_at.append(where[same])
            out_window.append(window[same])
            begin = end
        return (np.concatenate(out_at), np.concatenate(out_window)) if out_at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _same(self, loads: np.ndarray, n: int, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which windows' bytes stand at these places, compared 8 bytes at a time."""
        left = self.size[window]
        same = at + left <= n
        live, off = np.flatnonzero(same), 0
        while len(live):
            bits = np.minimum(left[live] - off, 8).astype(np.uint64) * np.uint64(8)
            unlike = (loads[at[live] + off] ^ self.loads[self.start[window[live]] + off]) << (np.uint64(64) - bits) != 0
            same[live[unlike]] = False
            off += 8
            live = live[~unlike]
            live = live[left[live] > off]
        return same

    def hits(self, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each document: its number of words, the runs [first, end) of hit words, the items that occur."""
        data, begin, at = normalised(block)
        first = np.searchsorted(begin, at)
        place, window = self.find(data)
        word = np.searchsorted(begin, place + 1)
        mark = np.zeros(len(begin) + 1, np.int32)
        np.add.at(mark, word, 1)
        np.add.at(mark, word + self.words[window], -1)
        hit = np.cumsum(mark[:-1]) > 0
        doc = np.searchsorted(first, word, "right") - 1
        one = np.unique(doc * len(self.start) + window)
        flat, ends = ragged(self.item_at, one % max(len(self.start), 1))
        both = np.unique(np.repeat(one // max(len(self.start), 1), np.diff(ends)) * max(len(self.items), 1) + self.item[flat])
        item_at = np.searchsorted(both // max(len(self.items), 1), np.arange(len(block) + 1))
        runs, items = [], []
        for d in range(len(block)):
            own = hit[first[d] : first[d + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) if item_at[d + 1] > item_at[d] else np.zeros(0, np.int64)
            runs.append(edge.reshape(-1, 2))
            items.append(both[item_at[d] : item_at[d + 1]] % max(len(self.items), 1))
        return np.diff(first), runs, items


def normalised(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents as ``" w1 w2 "`` one after the other and 8 spare bytes, where each word begins in that, and
    where each document does."""
    data = LOWER[block.data]
    inside = _word[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    edge = block.starts[:-1]
    edge = edge[edge < len(data)]
    head[edge] = inside[edge]
    ordinal = np.cumsum(head)
    count = np.concatenate([[0], ordinal])[block.starts]
    letters = np.concatenate([[0], np.cumsum(inside)])[block.starts]
    place = np.flatnonzero(inside)
    doc = np.searchsorted(block.starts, place, "right") - 1
    to = np.arange(len(place)) + ordinal[place] + doc
    out = np.full(len(place) + int(count[-1]) + len(block) + 8, 32, np.uint8)
    out[to] = data[place]
    return out, to[head[place]], letters + count + np.arange(len(block) + 1)


def pieces(benchmark: DataFrame) -> DataFrame:
    """Distinct (item, words) of a benchmark (item_id, text): pieces of at most PIECE words, joined by spaces."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    step = PIECE - WINDOW + 1
    begin = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - WINDOW), F.lit(step))
    cut = w.select("item", F.explode(F.transform(begin, lambda i: F.array_join(F.slice("w", i + 1, PIECE), " "))).alias("words"))
    return cut.distinct()


_spans = ArrayType(StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)]), False)


def contaminated(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """``docs`` (any columns, text among them) without its text, with ``n_words``, ``hits`` (runs of words inside
    an occurrence of a window, as ordinals from 0, end exclusive) and ``items`` (distinct ids, as strings, of the
    items of which a window occurs, by code point).

    Words are runs of ASCII letters and digits and of all beyond ASCII, A-Z in lower case. A window is WINDOW
    consecutive words of an item, or all of a shorter one; an item without words has none. Documents that are
    null or empty have no words and no hits. Rows of the benchmark that share an item_id are one item; a null
    item_id is listed as ''. Each row of ``docs`` gives one, repeated or not; no rows: none. Columns of ``docs``
    with a result's name are replaced.
    """
    docs = without(docs, "n_words", "hits", "items")
    texts = keep(pieces(benchmark), "windows")
    total, count = texts.agg(F.sum(F.octet_length("words")), F.count("*")).head()
    parts = max(1, -(-(total or 0) // part))
    dealt = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    while 1 < parts < count and max(r["size"] for r in texts.groupBy(dealt.alias("p")).agg(F.sum(F.octet_length("words")).alias("size")).orderBy(F.desc("size")).limit(1).collect()) > 2 * part:
        parts *= 2
        dealt = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    for p in range(parts):
        rows = [(r["item"], r["words"]) for r in texts.filter(dealt == p).collect()]
        docs = _pass(docs, Windows(rows), last=p == parts - 1)
        if p < parts - 1:
            docs = keep(docs, "searched")
    return docs


def _pass(docs: DataFrame, windows: Windows, last: bool) -> DataFrame:
    """One part's hits, joined with those that ``docs`` has from earlier parts."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    before = "hits" in docs.columns
    rest = [f for f in docs.schema.fields if f.name not in ("n_words", "hits", "items") and not (last and f.name == "text")]
    schema = StructType([*rest, StructField("n_words", LongType()), StructField("hits", _spans), StructField("items", ArrayType(StringType(), False))])
    kinds = [pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]), False)), pa.list_(pa.field("element", pa.string(), False))]

    def run(batches):
        known = shared.value
        names = np.array([*known.items, ""], object)
        for batch in batches:
            sizes, runs, items = [np.zeros(0, np.int64)], [], []
            for block in blocks(batch.column("text")):
                n, own, which = known.hits(block)
                sizes.append(n)
                runs += own
                items += which
            spans = [[{"start": a, "end": b} for a, b in r.tolist()] for r in runs]
            found = [names[i].tolist() for i in items]
            if before:
                spans = [_union(a, b) for a, b in zip(spans, batch.column("hits").to_pylist(), strict=True)]
                found = [sorted({*a, *b}, key=str.encode) for a, b in zip(found, batch.column("items").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(np.concatenate(sizes), pa.int64()), pa.array(spans, kinds[0]), pa.array(found, kinds[1])], schema.names)

    return docs.mapInArrow(run, schema)


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    """Runs that cover what either list's do."""
    out: list[dict] = []
    for x in sorted([*a, *b], key=lambda x: x["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], x["end"])}
        else:
            out.append(dict(x))
    return out
