"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a SentencePiece model cover the same bytes.

Both encoders run on chunks of a text: a space between two characters that are not white space begins a new
chunk, which neither encoder's pieces reach over, so that chunks encode as they do within the whole text. Each
distinct chunk is encoded once. The encoders' own offsets are coarse cuts; where a token is part of a character
(byte-level tokens, byte-fallback pieces), the lengths of the decoded bytes refine them.

Pairs of tokens are counted per unit of about ``UNIT`` bytes of text, then over the corpus; the counts of a
unit's distinct pairs are joined back to it, so that a pair which stands in every document is a row per unit.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep
from weftbase.llm.textbatch import Block, blocks, prefix_hash, ragged, segment_sums, span_hash

UNIT = 2_000_000
#: Chunks that a Python worker remembers; it starts anew beyond.
REMEMBERED = 400_000
#: New chunks looked at, and chunks encoded, at once.
ENCODED = 20_000
JOINED = 500

_plain = (np.arange(256) > 0x20) & (np.arange(256) != 0x7F)
#: Leading bytes of the characters among which are all white space beyond ASCII.
_wide = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1 for
    themselves, the others, in order, as the characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Encoder:
    """One vocabulary: the bytes of each id, and a function from chunks to ids with coarse spans in bytes."""

    spelled: np.ndarray
    spelled_at: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes]) -> Encoder:
        return cls(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]))

    def ends(self, ids: np.ndarray, count: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each token ends within its chunk. ``begin``, ``end``: coarse spans. A span that is as long as
        the token's bytes is right; from the last such one on, the lengths of the bytes are added up."""
        size = np.diff(self.spelled_at)[ids]
        upto = np.cumsum(size)
        first = np.cumsum(count) - count
        base = np.concatenate([[0], upto])[first]
        right = end - begin == size
        anchor = np.where(right, end - upto, 0)
        chunk = np.repeat(np.arange(len(count)), count)
        last = np.maximum.accumulate(np.where(right, np.arange(len(ids)), -1))
        known = last >= first[chunk]
        return upto + np.where(known, anchor[np.maximum(last, 0)], -base[chunk])

    def spells(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether the ids of each chunk decode to exactly its bytes."""
        ends = np.concatenate([[0], np.cumsum(count)])
        size = segment_sums(np.diff(self.spelled_at)[ids], ends)
        same = size == np.diff(starts)
        which = np.flatnonzero(np.repeat(same, count))
        made = self.spelled[ragged(self.spelled_at, ids[which].astype(np.int64))[0]]
        place, at = ragged(starts, np.flatnonzero(same))
        same[same] = segment_sums(made != data[place], at) == 0
        return same


@dataclass
class Index:
    """The place of each key, in two arrays: a worker's many chunks would take ten times as much as a dict."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.keys)

    def values(self) -> list[int]:
        return self.places.tolist()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys it does not have."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], -1).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """New keys get the next places."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.places = np.insert(self.places, at, (len(self.keys) + order).astype(np.int32))
        self.keys = np.insert(self.keys, at, keys[order])


@dataclass
class Known:
    """What is known of chunks, in order of first sight: counts of tokens and groups, the links' pairs
    (A's id * 2**32 + B's id), the texts of the groups, a byte after each; ``good``: whether both decode to the chunk."""

    index: Index = field(default_factory=Index)
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    link_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    good: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    groups: bytearray = field(default_factory=bytearray)
    group_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def texts(self, which: np.ndarray) -> list[bytes]:
        """The groups of each of these chunks."""
        begin, end = self.group_at[which], self.group_at[which + 1]
        return [bytes(self.groups[i:j]) for i, j in zip(begin.tolist(), np.maximum(begin, end - 1).tolist(), strict=True)]


class Aligner:
    """Two tokenizers, from the contents of their files, and the chunks they have encoded."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(byte_json)
        self.tokenizer.encode_special_tokens = True
        of = byte_characters()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        self.a = Encoder.of(spelled)
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b = Encoder.of([bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())])
        self.known = Known()

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """Of each tokenizer: ids, tokens of each chunk, where each token ends in its chunk. Chunks that begin and
        end as borders within a text do are encoded JOINED at a time, the others one by one."""
        last = starts[1:] - 1
        alone = ~_border(data, starts[:-1], data[last], data[last - 1], data[last - 2])
        head = np.arange(len(alone)) % JOINED == 0
        head |= alone
        head[1:] |= alone[:-1]
        at = np.append(starts[:-1][head], len(data))
        raw = data.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        point = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        # one text after the other, so that few of the encoders' own objects exist at once
        of_a, of_b = [], []
        for t in texts:
            e = self.tokenizer.encode(t, add_special_tokens=False)
            of_a.append((np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)))
            p = self.pieces.encode(t[1:], return_type="proto", num_threads=1).pieces
            of_b.append(np.fromiter(chain.from_iterable((x.id, x.begin, x.end) for x in p), np.int64, 3 * len(p)).reshape(-1, 3))
        n = np.array([len(x) for x, _ in of_a], np.int64)
        spans = np.concatenate([x for _, x in of_a])
        spans = point[np.minimum(spans + np.repeat(np.searchsorted(point, at[:-1]), n)[:, None], len(point) - 1)]
        ids = np.concatenate([x for x, _ in of_a])
        a = self._dealt(self.a, ids, spans[:, 0], spans[:, 1], starts)
        n = np.array([len(x) for x in of_b], np.int64)
        table = np.concatenate(of_b)
        base = np.repeat(at[:-1], n) + 1
        begin = table[:, 1] + base
        # the space that the encoder puts in front belongs to the first piece
        begin[(np.cumsum(n) - n)[n > 0]] = at[:-1][n > 0]
        return a, self._dealt(self.b, table[:, 0], begin, table[:, 2] + base, starts)

    @staticmethod
    def _dealt(encoder: Encoder, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by chunk, from their coarse spans in all chunks' bytes."""
        chunk = np.searchsorted(starts, begin, "right") - 1
        count = np.bincount(chunk, minlength=len(starts) - 1)
        return ids, count, encoder.ends(ids, count, begin - starts[chunk], end - starts[chunk])

    def learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode chunks (spans of ``data``) that are not known yet, and remember them under ``keys``."""
        for low in range(0, len(keys), ENCODED):
            part = slice(low, low + ENCODED)
            place, starts = _spans(start[part], end[part])
            own = data[place]
            (ids_a, n_a, end_a), (ids_b, n_b, end_b) = self.encode(own, starts)
            good = self.a.spells(ids_a, n_a, own, starts) & self.b.spells(ids_b, n_b, own, starts)
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            ids_a, end_a = ids_a[keep_a], (end_a + np.repeat(starts[:-1], n_a))[keep_a]
            ids_b, end_b = ids_b[keep_b], (end_b + np.repeat(starts[:-1], n_b))[keep_b]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            cuts, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b)
            # between two cuts lies one token of each, and tokens that overlap do so in one such place
            links = (ids_a[np.searchsorted(end_a, cuts)] << 32) + ids_b[np.searchsorted(end_b, cuts)]
            of_link, of_group = np.searchsorted(starts[1:], cuts), np.searchsorted(starts[1:], both)
            n_links, n_groups = np.bincount(of_link, minlength=len(good)), np.bincount(of_group, minlength=len(good))
            k = self.known
            k.index.add(keys[part])
            k.counts = np.concatenate([k.counts, np.stack([n_a, n_b, n_groups, n_links], 1)])
            k.links = np.concatenate([k.links, links])
            k.link_at = np.concatenate([k.link_at, k.link_at[-1] + np.cumsum(n_links)])
            k.good = np.concatenate([k.good, good])
            made, ends = _group_texts(ids_a, end_a, ids_b, end_b, both, n_a + n_b)
            k.groups += made
            k.group_at = np.concatenate([k.group_at, k.group_at[-1] + ends])

    def chunks(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The known chunk that each chunk of a block is, and where each document's begin. Empty texts have none."""
        size = np.diff(block.starts)
        filled = size > 0
        lead = np.concatenate([[0], np.cumsum(filled)])
        data = np.insert(block.data, block.starts[:-1][filled], 32)
        begin = block.starts + lead
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
        padded = np.concatenate([[0, 0, 0], data, [0]]).astype(np.uint8)
        start = np.flatnonzero(data == 32)
        start = start[_border(data, start, padded[start + 2], padded[start + 1], padded[start])]
        start = np.union1d(start, begin[:-1][filled])
        end = np.append(start[1:], len(data))
        key = span_hash(prefix_hash(data), start, end) + (end - start).astype(np.uint64)
        distinct, one, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known.index) > REMEMBERED:
            self.known = Known()
        new = self.known.index.find(distinct) < 0
        self.learn(distinct[new], data, start[one[new]], end[one[new]])
        which = self.known.index.find(distinct)
        return which[back], np.searchsorted(start, begin)


def _border(data: np.ndarray, at: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Whether spaces that stand ``at`` these places, after the bytes ``before`` (the nearest first), stand between
    characters that are surely no white space."""
    after = data[np.minimum(at + 1, len(data) - 1)]
    return _plain[before[0]] & _plain[after] & ~_wide[after] & ((before[0] < 0x80) | ~((before[1] == 0xC2) | _wide[before[2]]))


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the spans, one after the other, and where each begins among them."""
    at = np.concatenate([[0], np.cumsum(end - start)])
    return np.arange(at[-1]) + np.repeat(start - at[:-1], end - start), at


def _group_texts(ids_a: np.ndarray, end_a: np.ndarray, ids_b: np.ndarray, end_b: np.ndarray, both: np.ndarray, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The groups of each chunk as ``a1,a2|b1;a3|b2``, a byte after each, and where each ends. ``tokens``: of each chunk, A's and B's."""
    of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    after = np.concatenate([np.where(both[of_a] == end_a, ord("|"), ord(",")), np.where(both[of_b] == end_b, ord(";"), ord(","))])
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    ids = np.concatenate([ids_a, ids_b])[order]
    digits, at = _decimals(1 << max(int(ids.max()) if len(ids) else 0, 1).bit_length())
    flat, ends = ragged(at, ids)
    made = digits[flat]
    made[ends[1:] - 1] = after[order]
    return made.tobytes(), ends[np.cumsum(tokens)]


@functools.cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``n`` in decimals, a byte after each, and where each begins."""
    texts = [b"%d " % i for i in range(n)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


_aligners: dict[str, Aligner] = {}


def _aligner(files: tuple[str, bytes]) -> Aligner:
    """One for each pair of vocabularies; a Python worker keeps it from task to task."""
    name = sha256(files[0].encode() + b"\0" + files[1]).hexdigest()
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(*files)
    return _aligners[name]


def _files(byte_json: str, piece_model: str) -> tuple[str, bytes]:
    with open(byte_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
        return a.read(), b.read()


UNITS = (
    "unit long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, "
    "words binary, word_at binary, links binary, link_at binary, pairs array<struct<pair: long, n: long>>"
)


def _unit(aligner: Aligner, block: Block, doc_ids: pa.Array, number: int) -> dict:
    """Documents of a block, their chunks, the chunks' links, and the distinct pairs among these."""
    chunk, at = aligner.chunks(block)
    known = aligner.known
    n = np.diff(at)
    whole = (n > 0) & (segment_sums(~known.good[chunk], at) == 0)
    chunk, at = chunk[np.repeat(whole, n)], np.concatenate([[0], np.cumsum(np.where(whole, n, 0))])
    sums = [segment_sums(known.counts[chunk, i], at).tolist() for i in range(4)]
    used, words = np.unique(chunk, return_inverse=True)
    texts, names = known.texts(used), words.tolist()
    shas = [sha256(b";".join([texts[i] for i in names[at[d] : at[d + 1]]])).hexdigest() if whole[d] else "" for d in range(len(block))]
    links, link_at = ragged(known.link_at, used)
    pairs, link = np.unique(known.links[links], return_inverse=True)
    weight = np.repeat(np.bincount(words, minlength=len(used)), np.diff(link_at))
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, link, weight)
    return {
        "unit": number, "docs": [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row, strict=True)) for row in zip(doc_ids.to_pylist(), *sums, shas, strict=True)],
        "words": _small(words), "word_at": _small(at), "links": _small(link), "link_at": _small(link_at),
        "pairs": pa.StructArray.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"]),
    }


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in as many bytes as the largest needs, of which the first byte tells."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _large(raw: pa.Buffer) -> np.ndarray:
    kind = np.dtype(f"u{np.frombuffer(raw, np.uint8)[0]}")
    return np.frombuffer(raw, np.uint8)[1:].view(kind).astype(np.int64)


def align(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: the byte-level BPE of ``byte_json`` on a space and the text; B: the SentencePiece model on the text, to
    which it adds the space. Both files are read by the driver and sent to the tasks. A group is cut where
    tokens of both end. A link is a pair of tokens of A and B that share bytes. The count of a pair of ids is the
    number of links of the corpus that are of it; ``n_best`` are the document's links whose count is the highest
    of B's id (ties included), ``count_sum`` is the sum of its links' counts.

    A null or empty text, and one that the ids of A or B don't decode to, has no tokens: zeros and ''. Rows that
    share a doc_id, or have none, each give a row; other columns don't matter. No rows: none. Chunks are told
    apart by 64 bits and their length within what one worker remembers at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_files(byte_json, piece_model))
    kind = pa.struct([pa.field("pair", pa.int64()), pa.field("n", pa.int64())])
    document = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    names = ["unit", "docs", "words", "word_at", "links", "link_at", "pairs"]

    def run(batches):
        aligner, number = _aligner(shared.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch.column("text"), UNIT):
                row = _unit(aligner, block, batch.column("doc_id").slice(block.first, len(block)), number)
                number += 1
                pairs = row["pairs"].cast(kind)
                columns = [pa.array([row["unit"]], pa.int64()), pa.array([row["docs"]], pa.list_(document)), *[pa.array([row[c]], pa.binary()) for c in names[2:6]], pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)]
                yield pa.RecordBatch.from_arrays(columns, names)

    units = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, UNITS), "units")
    pairs = units.select("unit", F.inline("pairs"))
    counts = keep(pair_counts(pairs), "pair_counts")
    counted = pairs.select("unit", "pair").join(counts, "pair").select(F.col("unit").alias("counted"), "pair", "count", "best")
    return units.drop("pairs").groupBy("unit").cogroup(counted.groupBy("counted")).applyInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count, best (whether no other pair of the same id of B has more) from rows of pair and n."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(unit: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one unit with the sums over their links."""
    order = np.argsort(counted.column("pair").to_numpy())
    count, best = counted.column("count").to_numpy()[order], counted.column("best").to_numpy()[order].astype(np.int64)
    words, word_at, links, link_at = (_large(unit.column(c)[0].as_buffer()) for c in ("words", "word_at", "links", "link_at"))
    total, top = (segment_sums(segment_sums(x[links], link_at)[words], word_at) for x in (count, best))
    docs = pa.Table.from_struct_array(unit.column("docs").combine_chunks().flatten())
    made = {c: docs.column(c) for c in docs.column_names} | {"n_best": pa.array(top), "count_sum": pa.array(total)}
    return pa.table({c: made[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})


def groups(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """doc_id and ``groups``: of each document's groups, in order, the ids of A and those of B that cover the same
    bytes. Documents without tokens have none. For training across vocabularies."""
    shared = docs.sparkSession.sparkContext.broadcast(_files(byte_json, piece_model))

    def run(batches):
        aligner = _aligner(shared.value)
        for batch in batches:
            for block in blocks(batch.column("text"), UNIT):
                chunk, at = aligner.chunks(block)
                used, place = np.unique(chunk, return_inverse=True)
                texts, good, out = aligner.known.texts(used), aligner.known.good[used], []
                for d in range(len(block)):
                    own = place[at[d] : at[d + 1]]
                    both = [g.split("|") for i in own.tolist() for g in texts[i].decode().split(";")] if good[own].all() else []
                    out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in both])
                kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array(out, kind)], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
