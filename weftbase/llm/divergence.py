"""Quality rules: counts with fixed bars, and distance from a language's usual distributions.

A document's histograms of character classes and of its language's common words are compared with the
language's own by the Jensen-Shannon distance. Short texts lie further off by chance alone, so a distance is held against
those of the language's texts of like length: it is too far beyond a number of robust spreads above their
median. Texts below a least length are not judged by it: their histograms say too little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftbase.llm.scratch import keep, without
from weftbase.llm.textbatch import INNER, SPACE, Block, blocks, mix64, powers, prefix_hash, segment_sums, signed, span_hash, word_hashes, words, BASE

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Character classes: 0-25 small letters, then capitals, digits, first bytes beyond ASCII, blanks, line ends, stops, brackets and quotes, the rest.
N_CLASSES = 34
CLASS = np.full(256, 33, np.int64)
CLASS[ord("a") : ord("z") + 1] = np.arange(26)
CLASS[ord("A") : ord("Z") + 1] = 26
CLASS[ord("0") : ord("9") + 1] = 27
CLASS[0xC0:] = 28
CLASS[[0x20, 0x09]] = 29
CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 30
CLASS[[ord(c) for c in ".,;:!?"]] = 31
CLASS[[ord(c) for c in "()[]{}'\"-"]] = 32


#: Distances are counted in so many steps; bars come from at least LEAST_TEXTS texts and spreads of LEAST_SPREAD.
BINS, LEAST_TEXTS, LEAST_SPREAD = 2048, 30, 0.01
#: Bands of length: powers of two.
N_BANDS = 40


def class_counts(block: Block) -> np.ndarray:
    """Documents x character classes."""
    own = ~INNER[block.data]
    key = np.repeat(np.arange(len(block)), np.diff(block.starts)) * N_CLASSES + CLASS[block.data]
    return np.bincount(key[own], minlength=len(block) * N_CLASSES).reshape(len(block), N_CLASSES).astype(np.float64)


def repeated_words(hashes: np.ndarray, w, width: int) -> np.ndarray:
    """For each document, its words inside a ``width``-word window that the document holds twice or more."""
    n = len(hashes)
    covered = np.zeros(n + 1, np.int64)
    if n >= width:
        owner = w.document()
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key[: n - i] += hashes[i:] * powers(BASE, width + 1)[i + 1]
        at = np.flatnonzero(w.offsets[1:][owner] - np.arange(n) >= width)
        key = mix64(key[at] + owner[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return segment_sums((np.cumsum(covered)[:n] > 0).astype(np.int64), w.offsets)


def duplicate_lines(block: Block, w) -> np.ndarray:
    """For each document, its lines with a word that equal an earlier line of it."""
    out = np.zeros(len(block), np.int64)
    if not len(block.data):
        return out
    breaks = np.flatnonzero(block.data == 10)
    begin = np.unique(np.concatenate([block.starts[:-1], breaks + 1]))
    begin = begin[begin < len(block.data)]
    end = np.append(begin[1:], len(block.data))
    end = end - (block.data[end - 1] == 10)
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[held], end[held]
    owner = block.owner(begin)
    prefix = prefix_hash(block.data)
    key = mix64(span_hash(prefix, begin, end) + (end - begin).astype(np.uint64)) + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.lexsort((begin, key))
    again = order[1:][key[order][1:] == key[order][:-1]]
    return out + np.bincount(owner[again], minlength=len(block))


def counts(block: Block, w, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document; ``w`` and ``hashes``: the block's words."""
    data = block.data
    return {
        "n_words": w.counts,
        "word_chars": segment_sums((~INNER[data] & ~SPACE[data]).astype(np.int64), block.starts),
        "n_symbols": segment_sums(SYMBOLS[data].astype(np.int64), block.starts),
        "n_dup_lines": duplicate_lines(block, w),
        "n_repeat_words": repeated_words(hashes, w, 8),
    }


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2; 0 to 1) of each row of ``p`` from ``q``; rows are counts."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(total / 2, 0, 1))


def common_counts(hashes: np.ndarray, w, common: np.ndarray) -> np.ndarray:
    """Documents x (common words, all others): ``common`` are sorted hashes."""
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0)) if len(common) else np.zeros(len(hashes), int)
    kind = np.where(common[at] == hashes, at, len(common)) if len(common) else at
    width = len(common) + 1
    return np.bincount(w.document() * width + kind, minlength=len(w.counts) * width).reshape(-1, width).astype(np.float64)


def references(docs: DataFrame, n_common: int = 100) -> dict[str, dict[str, np.ndarray]]:
    """Per language, the sums over all its documents: ``classes``, and the hashes and counts of its
    ``n_common`` most frequent words (``common`` sorted, ``words`` with all others last), and the
    ``spreads`` of its texts' distances. The size follows the number of languages alone."""

    def tally(batches):
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                own = batch.filter(pa.compute.equal(langs, lang))
                for block in blocks(own.column("text")):
                    hashes, n = np.unique(word_hashes(block, words(block)), return_counts=True)
                    classes = class_counts(block).sum(0).astype(np.int64)
                    kind = np.concatenate([np.zeros(len(hashes), np.int32), np.ones(N_CLASSES, np.int32)])
                    key = np.concatenate([signed(hashes), np.arange(N_CLASSES)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(kind), pa.array(key), pa.array(np.concatenate([n, classes]))], ["lang", "kind", "key", "n"])

    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    sums = rows.mapInArrow(tally, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    sums = keep(sums, "histograms")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    totals = {r["lang"]: r["n"] for r in sums.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    classes = sums.filter("kind = 1").collect()
    common = sums.filter("kind = 0").withColumn("at", F.row_number().over(top)).filter(F.col("at") <= n_common).collect()
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in classes:
        out.setdefault(r["lang"], {"classes": np.zeros(N_CLASSES)})["classes"][r["key"]] = r["n"]
    for lang, own in out.items():
        found = sorted((np.int64(r["key"]).view(np.uint64), r["n"]) for r in common if r["lang"] == lang)
        own["common"] = np.array([k for k, _ in found], np.uint64)
        n = np.array([n for _, n in found], np.float64)
        own["words"] = np.append(n, totals.get(lang, 0) - n.sum())
    for lang, found in spreads(rows, out).items():
        out[lang]["spreads"] = found
    return out


def band(n: np.ndarray) -> np.ndarray:
    """The band of length of each number."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), N_BANDS - 1)


def robust(counts: np.ndarray) -> np.ndarray:
    """Bands x (median, spread) of counts (bands x ``BINS``): the spread is 1.4826 median deviations. A band of
    fewer than ``LEAST_TEXTS`` texts takes its neighbours in, as many as it needs; NaN where all are too few."""
    out = np.full((len(counts), 2), np.nan)
    at = (np.arange(counts.shape[1]) + 0.5) / counts.shape[1]
    for b in range(len(counts)) if counts.sum() >= LEAST_TEXTS else ():
        r = 0
        while (own := counts[max(b - r, 0) : b + r + 1].sum(0)).sum() < LEAST_TEXTS:
            r += 1
        middle = at[np.searchsorted(np.cumsum(own), own.sum() / 2)]
        order = np.argsort(np.abs(at - middle), kind="stable")
        off = np.abs(at - middle)[order][np.searchsorted(np.cumsum(own[order]), own.sum() / 2)]
        out[b] = middle, max(1.4826 * off, LEAST_SPREAD)
    return out


def spreads(rows: DataFrame, refs: dict) -> dict[str, np.ndarray]:
    """Per language, (class, word) x bands of length x (median, spread) of its texts' distances from its
    reference. Texts that the base counts fail are left out, equal ones count once. ``rows``: lang, text, both not null."""
    shared = rows.sparkSession.sparkContext.broadcast(refs)

    def measure(batches):
        refs = shared.value
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                own = batch.filter(pa.compute.equal(langs, lang))
                names = own.column("name").to_numpy()
                for block in blocks(own.column("text")):
                    w = words(block)
                    hashes = word_hashes(block, w)
                    passed = ~base_failed(w.counts, repeated_words(hashes, w, 8))
                    classes = class_counts(block)
                    far = js_distance(classes, refs[lang]["classes"]), js_distance(common_counts(hashes, w, refs[lang]["common"]), refs[lang]["words"])
                    size = classes.sum(1), w.counts
                    for kind in (0, 1):
                        held = passed & (size[kind] > 0)
                        name = names[block.first : block.first + len(block)][held]
                        step = np.minimum(far[kind][held] * BINS, BINS - 1).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(name)), pa.array(np.full(len(name), kind, np.int32)), pa.array(band(size[kind][held]).astype(np.int32)), pa.array(step), pa.array(name)], ["lang", "kind", "band", "step", "name"])

    one = rows.withColumn("name", F.xxhash64("text")).mapInArrow(measure, "lang string, kind int, band int, step int, name long").distinct()
    out = {lang: np.zeros((2, N_BANDS, BINS)) for lang in refs}
    for r in one.groupBy("lang", "kind", "band", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["lang"]][r["kind"], r["band"], r["step"]] = r["n"]
    return {lang: np.stack([robust(n) for n in own]) for lang, own in out.items()}


_added = StructType()
for _name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
    _added.add(_name, "long")
_added.add("base_failed", "boolean").add("class_distance", "double").add("word_distance", "double").add("kept", "boolean")


def judge(docs: DataFrame, refs: dict, min_chars: int = 200, min_words: int = 100, max_class: float = 0.45, max_words: float = 0.5, class_spreads: float = 10, word_spreads: float = 5, keep_text: bool = True) -> DataFrame:
    """``docs`` (any columns, text and lang among them) with the counts, base_failed, the distances and kept.

    A text is compared with the reference of its lang, or with the nearest of all where it has none that
    is known. It fails when its character classes lie more than ``class_spreads`` robust spreads beyond the
    median of that language's texts of like length (texts of ``min_chars`` characters or more), or its common
    words more than ``word_spreads`` (``min_words`` words or more). A language of too few texts to tell has
    the bars ``max_class`` and ``max_words``. Distances are null where they do not apply, as with no
    references at all. Null text counts as empty. Of references equally near the first by name is taken. Without
    ``keep_text`` the text does not come back from the tasks.
    """
    docs = without(docs, *_added.names)
    rest = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = StructType([*rest, *_added.fields])
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        refs = shared.value
        names = sorted(refs)
        bars = []
        for kind, (fixed, n) in enumerate(((max_class, class_spreads), (max_words, word_spreads))):
            own = np.array([refs[x]["spreads"][kind] if "spreads" in refs[x] else np.full((N_BANDS, 2), np.nan) for x in names]).reshape(-1, N_BANDS, 2)
            bars.append(np.where(np.isnan(own[..., 0]), fixed, own[..., 0] + n * own[..., 1]))
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            parts = []
            for block in blocks(batch.column("text")):
                w = words(block)
                hashes = word_hashes(block, w)
                own = counts(block, w, hashes)
                classes = class_counts(block)
                by_class = np.full((len(block), len(names)), np.nan)
                by_word = by_class.copy()
                for k, name in enumerate(names):
                    by_class[:, k] = js_distance(classes, refs[name]["classes"])
                    by_word[:, k] = js_distance(common_counts(hashes, w, refs[name]["common"]), refs[name]["words"])
                if names:
                    which = np.array([names.index(x) if x in refs else -1 for x in langs[block.first : block.first + len(block)]])
                    which = np.where(which < 0, by_class.argmin(1), which)
                    rows = np.arange(len(block))
                    own["class_distance"], own["word_distance"] = by_class[rows, which], by_word[rows, which]
                    own["class_bar"], own["word_bar"] = bars[0][which, band(classes.sum(1))], bars[1][which, band(own["n_words"])]
                else:
                    own["class_distance"] = own["word_distance"] = own["class_bar"] = own["word_bar"] = np.full(len(block), np.nan)
                own["class_distance"] = np.where(classes.sum(1) >= min_chars, own["class_distance"], np.nan)
                own["word_distance"] = np.where(own["n_words"] >= min_words, own["word_distance"], np.nan)
                parts.append(own)
            all_ = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*_added.names[:5], "class_distance", "word_distance", "class_bar", "word_bar")}
            all_["base_failed"] = base_failed(all_["n_words"], all_["n_repeat_words"])
            all_["kept"] = ~(all_["base_failed"] | (all_["class_distance"] > all_["class_bar"]) | (all_["word_distance"] > all_["word_bar"]))
            made = [pa.array(all_[f.name], pa.float64() if "distance" in f.name else pa.bool_() if f.name in ("kept", "base_failed") else pa.int64(), from_pandas=True) for f in _added.fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *made], schema.names)

    return docs.mapInArrow(run, schema)
