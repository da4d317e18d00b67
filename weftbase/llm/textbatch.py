"""Arrow string columns as byte arrays: words, hashes and sums per document, a block at a time.

Everything here works on whole texts. A block joins the bytes of consecutive documents up to about
``BLOCK`` bytes (a longer document is a block of its own), so memory follows the longest text and not
the size of the Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 2_000_000
#: Blocks for workers that shall stay small: their arrays, many times a block's size, also fit a core's cache better.
LEAN = 500_000
#: Batches of more bytes are worth giving memory back after.
LARGE = 4_000_000
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that do not begin a code point.
INNER = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CODES = np.random.default_rng(20240229).integers(1, 1 << 64, (2, 256), dtype=np.uint64)


@dataclass
class Block:
    """Consecutive documents: their bytes, and where each starts (one more entry than documents)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The document (within the block) of each byte position."""
        return np.searchsorted(self.starts, positions, "right") - 1


def give_back() -> None:
    """What this process has freed goes back to the system: Arrow's pool and the C library both keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.nbytes
        yield batch
        del batch
        if size > LARGE:
            give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, with memory given back after each large batch and at the end: a worker outlives its
    tasks, and what it keeps of one adds to the executor's memory in all later steps."""

    @functools.wraps(run)
    def call(batches):
        yield from run(_lean(batches))
        give_back()

    return call


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Split a string column into blocks; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.fill_null("").cast(pa.large_string())
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    ends = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield Block(i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(grown, out=grown)
        if n > 4 * BLOCK:
            return grown[:n]
        have = _powers[base] = grown
    return have[:n]


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` takes that of any byte range from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[seed][data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end): equal bytes give equal values wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block. ``counts``: of each document."""

    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(block: Block) -> Words:
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        zero = np.zeros(len(block), np.int64)
        return Words(none, none, zero, np.zeros(len(block) + 1, np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(len(data), bool)
    begins = block.starts[:-1]
    edge[begins[begins < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = edge[1:]
    end = np.flatnonzero(inside & (~after | last)) + 1
    offsets = np.searchsorted(start, block.starts)
    return Words(start, end, np.diff(offsets), offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment [offsets[i], offsets[i+1]); empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_hashes(block: Block, w: Words, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``fold`` lower-cases A-Z first."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    return span_hash(prefix_hash(LOWER[block.data] if fold else block.data), w.start, w.end)


def shingle_hashes(hashes: np.ndarray, w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the document of each.

    A document with fewer words (but at least one) gives its whole sequence as one shingle.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = w.document()
    full = np.zeros(n, np.uint64)
    for i in range(width):
        full[: n - i] += hashes[i:] * np.uint64(pow(BASE, i + 1, 1 << 64))
    left = w.offsets[1:][owner] - np.arange(n)
    whole = left >= width
    out, who = mix64(full[whole]), owner[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        made = [int(sum(int(h) * pow(BASE, i + 1, 1 << 64) for i, h in enumerate(hashes[w.offsets[d] : w.offsets[d + 1]])) + int(w.counts[d])) & ((1 << 64) - 1) for d in short]
        out = np.concatenate([out, mix64(np.array(made, np.uint64))])
        who = np.concatenate([who, short])
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    return out, who


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class HashIndex:
    """Exact lookup of 64-bit keys in a fixed set: an open-addressing table, probed a vector at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * max(len(keys), 1))))))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            taken, one = np.unique(at[self.slots[at] < 0], return_index=True)
            put = np.flatnonzero(self.slots[at] < 0)[one]
            self.slots[taken] = left[put]
            self.keys[taken] = keys[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key in the set, -1 where it is not in it."""
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


def ragged(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the segments ``which`` of [offsets[i], offsets[i+1]), one after the other, and
    the offsets of the segments in the result."""
    size = offsets[which + 1] - offsets[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return np.arange(ends[-1]) + np.repeat(offsets[which] - ends[:-1], size), ends
