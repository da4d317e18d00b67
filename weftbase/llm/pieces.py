"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is cut into words, each a run of blanks with what follows it; no piece reaches over such a border.
All distinct words of a block are searched at once, those of equal length advancing together one character
at a time: a substring's hash is looked up among the pieces' keys, and the best score and its back pointer
at each position are vectorised maxima. The pieces' own scores are summed; a character that no piece holds
costs 10 below the least score and becomes its UTF-8 bytes' pieces, so that decoding gives back any text.

Scores that are whole numbers are the merge ranks of a BPE model and no log-probabilities. A piece of rank r then
gets that of Zipf's law, -log(r + ``ZIPF``): the search finds the likeliest pieces, which are not those that the
model's own merges end in, though about as many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weftbase.llm.scratch import without
from weftbase.llm.textbatch import BASE, BASE_INVERSE, Block, HashIndex, blocks, lean, mix64, powers, ragged

BLANK = 0x2581
#: Stands for a literal U+2581 of the text, which is not a blank.
LITERAL = 0x110000
#: Words up to this many characters advance together; longer ones are rare and go one by one.
TOGETHER = 48
#: Characters looked up at once, and bytes of a block: more words of a large block repeat, but its arrays are many
#: times its size.
LOOKUPS = 150_000
WIDE = 500_000
ZIPF = 100


def _prefix(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(BASE)) * powers(BASE, len(points)), out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


class Pieces:
    """The vocabulary of a SentencePiece model file: pieces, scores, byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
        texts = [sp.id_to_piece(int(i)) for i in normal]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        crossing = [t for t in texts if any(a != chr(BLANK) and b == chr(BLANK) for a, b in zip(t, t[1:], strict=False))]
        if crossing:
            raise ValueError(f"pieces reach over word borders: {crossing[:3]}")
        self.ids = normal.astype(np.int32)
        self.scores = np.array([sp.get_score(int(i)) for i in normal], np.float64)
        if (self.scores == np.floor(self.scores)).all():
            self.scores = -np.log(ZIPF - self.scores)
        self.longest = int((ends - begins).max())
        prefix = _prefix(points)
        heads = np.concatenate([_hash(prefix, begins[ends - begins >= k], begins[ends - begins >= k] + k) for k in range(1, self.longest + 1)])
        heads = np.unique(heads)
        #: All beginnings of pieces; ``piece_of`` has the piece that one is itself, or -1.
        self.index = HashIndex(heads)
        self.piece_of = np.full(len(heads) + 1, -1, np.int32)
        self.piece_of[np.searchsorted(heads, _hash(prefix, begins, ends))] = np.arange(len(begins))
        self.unknown = self.scores.min() - 10.0
        self.scores = np.append(self.scores, -np.inf)
        self.bytes = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        spelled = [b""] * n
        for i, t in zip(normal, texts, strict=True):
            spelled[i] = t.replace(chr(BLANK), " ").encode()
        for b, i in enumerate(self.bytes):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def _lookup(self, prefix: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin at each place and their scores: rows of lengths, the longest first.

        ``left``: characters from the place to its word's end. A place drops out as soon as no piece begins
        with its characters.
        """
        found = np.full((self.longest, len(at)), -1, np.int32)
        scores = np.full((self.longest, len(at)), -np.inf)
        live = np.arange(len(at))
        inverse = powers(BASE_INVERSE, len(prefix))[at]
        for size in range(1, self.longest + 1):
            live = live[left[live] >= size]
            head = self.index.find(mix64((prefix[at[live] + size] - prefix[at[live]]) * inverse[live]))
            live, head = live[head >= 0], head[head >= 0]
            own = self.piece_of[head]
            found[self.longest - size, live] = own
            scores[self.longest - size, live] = self.scores[own]
        np.copyto(scores[-1], self.unknown, where=found[-1] < 0)
        return found, scores

    def _together(self, found: np.ndarray, scores: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of words of ``n`` characters: for each end, where its last piece begins, and
        that piece. ``first``: the column of each word's first character in the lookups."""
        m = len(first)
        best = np.zeros((n + 1, m))
        back = np.zeros((n + 1, m), np.int32)
        piece = np.full((n + 1, m), -1, np.int32)
        rows = np.arange(m)
        for end in range(1, n + 1):
            sizes = np.arange(min(self.longest, end), 0, -1)
            column = first + (end - sizes)[:, None]
            row = (self.longest - sizes)[:, None]
            total = scores[row, column] + best[end - sizes]
            k = total.argmax(0)
            best[end] = total[k, rows]
            back[end] = end - sizes[k]
            piece[end] = found[row[k, 0], column[k, rows]]
        return back, piece

    def _alone(self, prefix: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of one long word begin, and the pieces: searched position by position, looked up a
        stretch at a time."""
        n = end - start
        best, back, piece = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        for low in range(0, n, LOOKUPS):
            high, first = min(n, low + LOOKUPS), max(0, low + 1 - self.longest)
            place = np.arange(start + first, start + high)
            found, scores = self._lookup(prefix, place, end - place)
            for to in range(low + 1, high + 1):
                size = min(self.longest, to)
                row, column = np.arange(self.longest - size, self.longest), np.arange(to - size - first, to - first)
                total = scores[row, column] + best[to - size : to]
                k = int(total.argmax())
                best[to], back[to], piece[to] = total[k], to - size + k, found[row[k], column[k]]
        ends = [n]
        while back[ends[-1]]:
            ends.append(int(back[ends[-1]]))
        ends = np.array(ends[::-1])
        return start + back[ends], piece[ends]

    def _words(self, points: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and where each word's begin."""
        size = end - start
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(size > TOGETHER):
            begin, piece = self._alone(prefix, int(start[w]), int(end[w]))
            out.append((np.full(len(begin), w), begin, piece))
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= TOGETHER]
        upto = np.cumsum(size[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKUPS, "right")))
            part = order[at:to]
            at = to
            own = size[part]
            column = np.concatenate([[0], np.cumsum(own)])
            place = np.arange(column[-1]) + np.repeat(start[part] - column[:-1], own)
            found, scores = self._lookup(prefix, place, np.repeat(end[part], own) - place)
            for n in np.unique(own):
                of = np.flatnonzero(own == n)
                back, piece = self._together(found, scores, column[of], int(n))
                here, rows = np.full(len(of), n), np.arange(len(of))
                while len(rows):
                    begin = back[here, rows]
                    out.append((part[of[rows]], start[part[of[rows]]] + begin, piece[here, rows].astype(np.int64)))
                    more = begin > 0
                    here, rows = begin[more], rows[more]
        word, begin, piece = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((begin, word))
        word, begin, piece = word[order], begin[order], piece[order]
        known = piece >= 0
        lost = points[begin[~known]]
        lost = np.where(lost == LITERAL, BLANK, np.where(lost == BLANK, 32, lost)).astype("<u4")
        length = np.ones(len(piece), np.int64)
        length[~known] = 1 + np.searchsorted([0x80, 0x800, 0x10000], lost, "right")
        at = np.concatenate([[0], np.cumsum(length)])
        ids = np.zeros(at[-1], np.int32)
        ids[np.repeat(~known, length)] = self.bytes[np.frombuffer(lost.tobytes().decode("utf-32-le").encode(), np.uint8)]
        ids[at[:-1][known]] = self.ids[piece[known]]
        return ids, at[np.searchsorted(word, np.arange(len(start) + 1))]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and the offsets of each document's. An empty text has none."""
        raw = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.starts]
        size = np.diff(first)
        filled = size > 0
        lead = np.concatenate([[0], np.cumsum(filled)])
        points = np.full(len(raw) + int(filled.sum()), BLANK, np.uint32)
        points[np.arange(len(raw)) + np.repeat(lead[1:], size)] = np.where(raw == BLANK, LITERAL, np.where(raw == 32, BLANK, raw))
        begin = first + lead
        blank = points == BLANK
        border = blank.copy()
        border[1:] &= ~blank[:-1]
        heads = begin[:-1][filled]
        border[heads] = True
        start = np.flatnonzero(border)
        end = np.append(start[1:], len(points))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64)
        prefix = _prefix(points)
        key = _hash(prefix, start, end) + (end - start).astype(np.uint64)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        ids, at = self._words(points, prefix, start[one], end[one])
        flat, ends = ragged(at, back)
        return ids[flat], ends[np.searchsorted(start, begin)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts, and the offsets of each: the leading blank of each text is taken off."""
        flat, ends = ragged(self.spelled_at, ids.astype(np.int64))
        data, at = self.spelled[flat], ends[offsets]
        filled = np.diff(at) > 0
        keep = np.ones(len(data), bool)
        keep[at[:-1][filled]] = False
        return data[keep], at - np.concatenate([[0], np.cumsum(filled)])


_ids = ArrayType(IntegerType(), False)


def encode(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """``docs`` (any columns, text among them) with ``ids`` and ``round_trip`` (whether the ids decode to
    exactly the text). Null and empty texts have no ids. Of equally good segmentations of a word, that whose
    last pieces are the longest is taken. Without ``keep_text`` the text does not come back from the tasks."""
    docs = without(docs, "ids", "round_trip")
    rest = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = StructType([*rest, StructField("ids", _ids)]).add("round_trip", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    @lean
    def run(batches):
        pieces = shared.value
        for batch in batches:
            for block in blocks(batch.column("text"), WIDE):
                own, at = pieces.encode(block)
                data, ends = pieces.decode(own, at)
                if len(data) == len(block.data) and np.array_equal(ends, block.starts) and np.array_equal(data, block.data):
                    same = np.ones(len(block), bool)
                else:
                    same = np.array([np.array_equal(data[ends[i] : ends[i + 1]], block.data[block.starts[i] : block.starts[i + 1]]) for i in range(len(block))])
                made = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own)).cast(pa.list_(pa.field("element", pa.int32(), False)))
                part = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], made, pa.array(same)], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (any columns, ids among them) with ``decoded``; null ids give the empty text. Ids that spell
    no valid UTF-8 give U+FFFD in its place."""
    rows = without(rows, "decoded")
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches):
        pieces = shared.value
        for batch in batches:
            column = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), offsets)
            raw = data.tobytes()
            texts = [raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
