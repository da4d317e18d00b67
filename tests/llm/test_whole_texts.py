"""Operators 2 and 10 on whole texts of the given tables, against loops over characters and words."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from weftbase.llm import divergence, queries
from weftbase.llm.textbatch import blocks, signed, word_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PADDED = b"\n\n\n"


def contexts(texts):
    """How often each byte followed each context of 0 to 3 bytes."""
    out = defaultdict(Counter)
    for text in texts:
        data = PADDED + text.encode().lower()
        for i in range(3, len(data)):
            for k in range(4):
                out[data[i - k : i]][data[i]] += 1
    return out


def code_length(tree, text):
    data, bits = PADDED + text.encode().lower(), 0.0
    for i in range(3, len(data)):
        gone = set()
        for k in (3, 2, 1, 0):
            own = tree.get(data[i - k : i])
            left = {b: n for b, n in (own or {}).items() if b not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                bits += math.log2(whole / left[data[i]])
                break
            bits += math.log2(whole / len(left))
            gone |= set(own)
        else:
            bits += math.log2(max(256 - len(tree[b""]), 1))
    return bits


def test_language_scores_of_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    assert {i: r.held_out for i, r in got.items()} == held
    fit = [d for d in docs if not held[d.doc_id] and d.lang is not None and d.text]
    trees = {x: contexts([d.text for d in fit if d.lang == x]) for x in sorted({d.lang for d in fit})}
    short = sorted((d for d in docs if d.text and any(c.isalpha() for c in d.text)), key=lambda d: len(d.text))
    for d in short[:15] + short[len(short) // 2 : len(short) // 2 + 10]:
        bits = {x: code_length(t, d.text) for x, t in trees.items()}
        best = min(bits, key=bits.get)
        assert got[d.doc_id].lang_pred == best
        assert math.isclose(got[d.doc_id].bits_per_byte, bits[best] / len(d.text.encode()), rel_tol=1e-9)
        assert math.isclose(got[d.doc_id].score, 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values()), rel_tol=1e-6)


def class_of(c):
    if "a" <= c <= "z":
        return ord(c) - ord("a")
    if ord(c) > 127:
        return 28
    for number, of in ((26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (27, "0123456789"), (29, " \t"), (30, "\n\x0b\x0c\r"), (31, ".,;:!?"), (32, "()[]{}'\"-")):
        if c in of:
            return number
    return 33


def distance(p, q):
    """Jensen-Shannon distance of two counters, base 2."""
    a, b, total = sum(p.values()) or 1, sum(q.values()) or 1, 0.0
    for k in set(p) | set(q):
        x, y = p[k] / a, q[k] / b
        total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v)
    return math.sqrt(max(total / 2, 0))


def bar(found, band, fixed, n):
    """``found``: (band, distance by steps) of a language's texts."""
    if len(found) < 30:
        return fixed
    r = 0
    while len(own := sorted(x for b, x in found if abs(b - band) <= r)) < 30:
        r += 1
    middle = own[math.ceil(len(own) / 2) - 1]
    off = sorted(abs(x - middle) for x in own)[math.ceil(len(own) / 2) - 1]
    return middle + n * max(1.4826 * off, 0.01)


def test_quality_verdicts_of_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    classes = {d.doc_id: Counter(map(class_of, d.text or "")) for d in docs}
    tokens = {d.doc_id: WORD.findall(d.text or "") for d in docs}
    known = [d for d in docs if d.lang is not None and d.text is not None]
    langs = sorted({d.lang for d in known})
    of_class, of_word, common = {x: Counter() for x in langs}, {x: Counter() for x in langs}, {}
    for d in known:
        of_class[d.lang].update(classes[d.doc_id])
        of_word[d.lang].update(tokens[d.doc_id])
    for x in langs:
        block = next(blocks(pa.array([" ".join(of_word[x])])))
        ties = dict(zip(of_word[x], signed(word_hashes(block, words(block))).tolist(), strict=True))
        common[x] = set(sorted(of_word[x], key=lambda t: (-of_word[x][t], ties[t]))[:100])

    def by_common(counts, x):
        return Counter({t: n for t, n in counts.items() if t in common[x]}) + Counter({None: sum(n for t, n in counts.items() if t not in common[x])})

    def far(d, x):
        return distance(classes[d.doc_id], of_class[x]), distance(by_common(Counter(tokens[d.doc_id]), x), by_common(of_word[x], x))

    band = lambda n: int(math.log2(max(n, 1)))
    found = defaultdict(list)
    for lang, text in {(d.lang, d.text) for d in known}:
        d = next(d for d in known if d.text == text and d.lang == lang)
        if got[d.doc_id].base_failed:
            continue
        for kind, (x, size) in enumerate(zip(far(d, lang), (len(text), len(tokens[d.doc_id])), strict=True)):
            if size:
                found[lang, kind].append((band(size), (min(int(x * 2048), 2047) + 0.5) / 2048))
    for d in docs:
        n_words, r = len(tokens[d.doc_id]), got[d.doc_id]
        assert r.n_words == n_words and r.base_failed == (n_words < 20 or 100 * r.n_repeat_words > 30 * n_words)
        x = d.lang if d.lang in langs else min(langs, key=lambda y: far(d, y)[0])
        by_class, by_word = far(d, x)
        size = len(d.text or "")
        odd = (size >= 200 and by_class > bar(found[x, 0], band(size), 0.45, 10)) or (n_words >= 100 and by_word > bar(found[x, 1], band(n_words), 0.5, 5))
        assert r.kept == (not r.base_failed and not odd), d.doc_id
        assert r.class_distance is None if size < 200 else np.isclose(r.class_distance, by_class)
    assert not all(r.kept for r in got.values() if not r.base_failed) and divergence.BINS == 2048
