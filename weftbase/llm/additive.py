"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Shallow trees on one feature at a time, in turn and with a small
step, add up to one lookup table per feature; then the pairs whose four-quadrant split gains most on what
is left get tables of their own. Scoring adds table entries: no tree is kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from weftbase.llm.divergence import counts
from weftbase.llm.scratch import keep, without
from weftbase.llm.textbatch import INNER, Block, blocks, segment_sums, word_hashes, words

FEATURES = (
    "log_words", "mean_word", "capitals", "digits", "stops", "marks", "symbols", "beyond_ascii", "bars", "shouts",
    "distinct", "repeats", "repeated_lines", "words_a_line", "words_a_stop", "short_words", "long_words",
)


def _table(*sets: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in sets:
        out[[ord(c) for c in s]] = True
    return out


_CAPITAL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_STOP = _table(".!?")
_MARK = _table(",;:'\"()[]{}-_/\\")


def features(block: Block) -> np.ndarray:
    """Documents x FEATURES, from the bytes of the texts alone."""
    data, w = block.data, words(block)
    hashes = word_hashes(block, w)
    base = counts(block, w, hashes)
    own = ~INNER[data]
    chars = np.maximum(segment_sums(own.astype(np.int64), block.starts), 1)
    n = np.maximum(w.counts, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return segment_sums(mask.astype(np.int64), block.starts) / chars

    owner = w.document()
    key = hashes + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    size = w.end - w.start
    lines = segment_sums((data == 10).astype(np.int64), block.starts) + 1
    stops = share(_STOP[data])
    return np.stack([
        np.log1p(w.counts), base["word_chars"] / n, share(_CAPITAL[data]), share(_DIGIT[data]), stops, share(_MARK[data]),
        base["n_symbols"] / chars, share((data >= 0xC0)), share(data == ord("|")), share(data == ord("!")),
        np.bincount(owner[order], new, len(block)) / n, base["n_repeat_words"] / n, base["n_dup_lines"] / lines,
        np.log1p(w.counts / lines), np.log1p(w.counts / (stops * chars + 1)),
        np.bincount(owner, size <= 3, len(block)) / n, np.bincount(owner, size >= 14, len(block)) / n,
    ], 1)


def feature_table(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, text among them) with ``features`` (array<double>) in place of the text."""
    docs = without(docs, "features")
    rest = [f for f in docs.schema.fields if f.name.lower() != "text"]
    schema = StructType([*rest]).add("features", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            made = [features(b) for b in blocks(batch.column("text"))]
            table = np.concatenate(made) if made else np.zeros((0, len(FEATURES)))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(FEATURES)), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], column], schema.names)

    return docs.mapInArrow(run, schema)


def _steps(gradient: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The values of a shallow tree over the bins of one feature (Newton steps)."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + ridge))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        gain = g**2 / (h + ridge) + (gradient.sum() - g) ** 2 / (weight.sum() - h + ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > gradient.sum() ** 2 / (weight.sum() + ridge) + 1e-9:
            out = np.concatenate([_steps(gradient[:cut], weight[:cut], depth - 1, ridge), _steps(gradient[cut:], weight[cut:], depth - 1, ridge)])
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best split of a pair's grid into four quadrants: its gain and the grid of Newton steps."""
    best, grid = 0.0, np.zeros_like(gradient)
    if min(gradient.shape) < 2:
        return best, grid
    sums = []
    for table in (gradient, weight):
        c = table.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        sums.append((a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a))
    gain = sum(g**2 / (h + ridge) for g, h in zip(*sums, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = [g[i, j] / (h[i, j] + ridge) for g, h in zip(*sums, strict=True)]
    grid[: i + 1, : j + 1], grid[: i + 1, j + 1 :], grid[i + 1 :, : j + 1], grid[i + 1 :, j + 1 :] = step
    return float(gain[i, j] - gradient.sum() ** 2 / (weight.sum() + ridge)), grid


class Additive:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 60, pairs: int = 6, rate: float = 0.15, ridge: float = 4.0) -> None:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) if n else np.zeros(0) for j in range(k)]
        self.wide = [np.unique(np.quantile(x[:, j], np.arange(1, coarse) / coarse)) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        self.intercept = 0.0
        if not n:
            return
        share = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
        self.intercept = float(np.log(share / (1 - share)))
        own = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        few = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.wide)]
        total = np.full(n, self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for j in range(k):
                g, h = slopes()
                size = len(self.tables[j])
                step = rate * _steps(np.bincount(own[j], g, size), np.bincount(own[j], h, size), 2, ridge)
                self.tables[j] += step
                total += step[own[j]]
        g, h = slopes()

        def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
            shape = len(self.wide[a]) + 1, len(self.wide[b]) + 1
            return np.bincount(few[a] * shape[1] + few[b], values, shape[0] * shape[1]).reshape(shape)

        gains = {(a, b): _quadrants(grid(a, b, g), grid(a, b, h), ridge)[0] for a, b in itertools.combinations(range(k), 2)}
        self.pairs = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:pairs] if gains[p] > 0]
        self.grids = [np.zeros((len(self.wide[a]) + 1, len(self.wide[b]) + 1)) for a, b in self.pairs]
        for _ in range(rounds):
            for m, (a, b) in enumerate(self.pairs):
                g, h = slopes()
                step = rate * _quadrants(grid(a, b, g), grid(a, b, h), ridge)[1]
                self.grids[m] += step
                total += step[few[a], few[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.wide[a], x[:, a], "right"), np.searchsorted(self.wide[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(table: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Additive:
    """Fit on the rows of a feature table whose doc_id ``labels`` (doc_id, quality) marks 0 or 1.

    ``sample_rows`` bounds what is fitted on: of more labelled rows, a hash picks about so many. With none,
    every score is 0.5.
    """
    marked = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    rows = keep(table.select("doc_id", "features").join(marked, "doc_id"), "marked")
    share = min(1.0, sample_rows / max(rows.count(), 1))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    sample = chosen.orderBy("doc_id", "quality").toPandas()
    x = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return Additive(x, sample["quality"].to_numpy(np.float64))


def score(table: DataFrame, model: Additive) -> DataFrame:
    """A feature table with ``score`` (0 to 1) in place of the features."""
    table = without(table, "score")
    shared = table.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in table.schema.fields if f.name != "features"]
    schema = StructType([*rest]).add("score", "double")

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(shared.value.score(x))], schema.names)

    return table.mapInArrow(run, schema)
