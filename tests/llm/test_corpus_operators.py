"""Operators that compare documents: against brute force on given and planted rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftbase.llm import jaccard_join, links, neighbours, paragraphs, repeat_bytes, repeats, scratch
from weftbase.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(t, k=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_groups(sets):
    groups = Groups()
    items = [(k, s) for k, s in sets.items() if s]
    for k in sets:
        groups.find(k)
    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            common = len(s & t)
            if 100 * common >= 80 * (len(s) + len(t) - common):
                groups.join(a, b)
    return groups


def planted(seed=0):
    """Copies, near copies in a chain, a large group of near copies of one text, a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(60)
    out = [None, "", " \n", "a", "a", "a b c", "A B c", "x y z"]
    for _ in range(12):
        t = text(rng.randrange(20, 200))
        out += [" ".join(t), " ".join(t).upper(), " ".join(t[:-1] + [word()]), " ".join(t[: len(t) // 2])]
    base = text(120)
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    chain = text(90)
    for i in range(8):
        chain = chain[3:] + text(3)
        out.append(" ".join(chain))
    for _ in range(70):
        t = text(rng.randrange(30, 120))
        at = rng.randrange(len(t))
        out.append(" ".join(t[:at]) + "\n" + " ".join(passage) + "\n" + " ".join(t[at:]))
    out.append("\n".join([" ".join(passage)] * 3))
    rng.shuffle(out)
    return out


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, member string, n int").repartition(parts)


@pytest.mark.parametrize(("seed", "few"), [(0, 128), (1, 3)])
def test_jaccard_join(spark, monkeypatch, seed, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    texts = planted(seed)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    groups = plain_groups(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(frame(spark, texts)).collect()}
    assert got == {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.similar_documents(frame(spark, ["x"]).filter("false")).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in jaccard_join.similar_documents(rows).collect()), key=str)
    assert got == [("5", 5), ("5", 5), ("None", 5), ("None", None)]


def test_jaccard_join_of_repeated_ids_and_unlike_copies(spark):
    """Rows that share a doc_id or have none; a group of copies of one text most of which are unlike each other."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(140)
            t[at : at + 6] = [f"x{i}.{at}.{k}" for k in range(6)]
        texts.append(" ".join(t))
    texts += [" ".join(f"q{k}" for k in range(30)), " ".join(f"q{k}" for k in range(31)), " ".join(f"r{k}" for k in range(50))]
    ids = [*range(120), 120, None, 120]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(rows).collect())
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    groups = plain_groups(sets)
    want = Counter((ids[i], len(s), groups.find(i)) for i, s in sets.items() if i < 120)
    assert 1 < len({groups.find(i) for i in range(120)}) < 120
    assert got == want + Counter({(120, 26, 120): 1, (None, 27, 120): 1, (120, 46, 120): 1})


def test_paragraphs(spark):
    texts = planted(2)
    sets = {(i, k): shingles(x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(re.findall(WORD, x)) >= 20}
    groups = plain_groups(sets)
    size = Counter(groups.find(k) for k in sets)
    got = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.kept_paragraph, r.removed) for r in paragraphs.repeated_paragraphs(frame(spark, texts)).collect()}
    assert got == {k: (*groups.find(k), groups.find(k) != k) for k in sets if size[groups.find(k)] > 1}
    assert paragraphs.repeated_paragraphs(frame(spark, ["x"]).filter("false")).count() == 0


def test_paragraphs_of_repeated_rows(spark):
    """Equal rows, rows that share a doc_id but not the text, and rows without doc_id are documents of their own."""
    line = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, line("a")), (1, line("a")), (1, line("b")), (2, line("b")), (None, line("c")), (3, line("c")), (None, None), (4, ""), (5, line("d"))]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, paragraph string, row int")
    got = Counter((r.doc_id, r.kept_doc_id, r.removed) for r in paragraphs.repeated_paragraphs(docs).collect())
    assert got == Counter({(1, 1, False): 2, (1, 1, True): 1, (2, 1, True): 1, (None, None, False): 1, (3, None, True): 1})
    assert Counter((r.doc_id, r.kept_doc_id, r.removed) for r in paragraphs.repeated_text(docs).collect()) == got


@pytest.mark.parametrize("few", [2, 5])
def test_paragraphs_of_large_bands(spark, monkeypatch, few):
    """Pairs of one template in a band of more than ``FEW``, most of them unlike each other."""
    monkeypatch.setattr(paragraphs, "FEW", few)
    rng = random.Random(8)
    template, texts = [f"t{i}" for i in range(100)], []
    for i in range(40):
        shared = [f"x{i}w{k}" for k in range(10)]
        texts += [" ".join(template + shared + [f"{side}{i}w{k}" for k in range(10)]) for side in "ab"]
    rng.shuffle(texts)
    groups = plain_groups({(i, 0): shingles(x) for i, x in enumerate(texts)})
    shown = []
    monkeypatch.setattr(paragraphs, "repeated", lambda rows: shown.append(scratch.keep(repeats.repeated(rows), "shown")) or shown[0])
    got = {r.doc_id: r.kept_doc_id for r in paragraphs.repeated_paragraphs(frame(spark, texts)).collect()}
    together = {}
    for r in shown[0].collect():
        together.setdefault(r.key, set()).add(r.member)
    assert max(map(len, together.values())) > few
    tables = {r.doc_id: r.member for r in paragraphs.paragraph_table(frame(spark, texts)).collect()}
    collide = [(i, k[0]) for (i, _), k in ((x, groups.find(x)) for x in list(groups)) if i != k[0] and any({tables[i], tables[k[0]]} <= x for x in together.values())]
    assert len(collide) > 20 and all(got.get(i) == k for i, k in collide)


def test_tiles_find_every_pair(spark):
    """All in one key, against brute force."""
    rng = random.Random(9)
    sets = {}
    for m in range(90):
        base = rng.randrange(30)
        x = set(range(1000 * base, 1000 * base + rng.randrange(18, 26))) | set(range(5))
        x -= set(rng.sample(sorted(x), 2))
        sets[m + 1] = frozenset(x)
    groups = plain_groups(sets)
    rows = [(m, len(x), np.array(sorted(x), np.uint64).tobytes()) for m, x in sets.items()]
    table = spark.createDataFrame(rows, "member long, n long, tokens binary")
    open_ = table.selectExpr("7L as key", "member", "member as component")
    for few in (2, 16):
        got = Groups()
        for m in sets:
            got.find(m)
        for r in links.within_tiles(open_, table, few).collect():
            got.join(r.a, r.b)
        assert all(got.find(m) == groups.find(m) for m in sets)


def test_passages_within_lines(spark):
    """Every run of 50 words that two lines share is caught, and nothing of what they do not."""
    rng = random.Random(10)
    own = iter(range(10**6))
    text = lambda n: [f"w{next(own)}" for _ in range(n)]
    texts, where = [], {}
    for i in range(40):
        passage = text(50 + i % 20)
        for _ in range(2):
            before = text(rng.randrange(60, 120))
            where[len(texts)] = (len(before), len(before) + len(passage), 2 * i)
            texts.append("head\n" + " ".join(before + passage + text(rng.randrange(60, 120))))
    texts += [" ".join(text(150)) for _ in range(5)] + [None, "", texts[0]]
    rows = paragraphs.repeated_text(frame(spark, texts)).filter("first_word is not null").collect()
    assert {r.doc_id for r in rows} == set(where)
    for r in rows:
        low, high, first = where[r.doc_id]
        assert r.paragraph == 1 and low <= r.first_word and r.first_word + r.n_words <= high and r.n_words >= paragraphs.SEED
        assert (r.kept_doc_id, r.kept_paragraph, r.removed) == (first, 1, r.doc_id != first)
    assert paragraphs.repeated_text(frame(spark, ["x"]).filter("false")).count() == 0


def test_shared_run_within_longer_lines(spark):
    """In sf0.01 documents 85 and 676 share a run of 59 words within unlike lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id in (85, 676)")
    rows = {(r.doc_id, r.paragraph, r.kept_doc_id) for r in paragraphs.repeated_text(docs).collect()}
    assert {(85, 2, 85), (676, 3, 85)} <= rows


def test_tuning_meets_recall():
    for s in (0.5, 0.8, 0.9):
        b, r = paragraphs.tune(s, 0.99)
        assert 1 - (1 - s**r) ** b >= 0.99 > 1 - (1 - s ** (r + 1)) ** b


def plain_removal(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        off = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                off[p] += 1
                off[p + 100] -= 1
            else:
                seen[w] = 1
        gone = np.cumsum(off[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("few", [512, 2])
def test_repeat_bytes(spark, monkeypatch, few):
    monkeypatch.setattr(repeat_bytes, "FEW", few)
    rng = random.Random(6)
    common = "".join(rng.choice("abc ") for _ in range(400))
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 120, "é" * 80, "é" * 80 + "x", common, common, common[:250], "zz" + common[100:199] + "q", "zz" + common[100:200] + "q"]
    for _ in range(40):
        at = rng.randrange(300)
        own = "".join(rng.choice("xyz ") for _ in range(rng.randrange(150)))
        texts.append(own + common[at : at + rng.randrange(60, 160)] + own[::-1] + common[:rng.randrange(130)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_bytes.remove_repeats(frame(spark, texts)).collect()}
    assert got == plain_removal(texts)
    assert repeat_bytes.remove_repeats(frame(spark, ["x"]).filter("false")).count() == 0


def test_repeat_bytes_of_repeated_ids(spark):
    """Equal rows are one document; other texts of a doc_id come in the order of their hashes."""
    rng = random.Random(9)
    common = "".join(rng.choice("abc ") for _ in range(300))
    rows = [(rng.choice([None, 1, 1, 2, 3, 2**62]), common[: rng.randrange(300)] + str(i % 9) + common[rng.randrange(200) :]) for i in range(40)]
    rows += [*rows[:12], (1, None), (1, ""), (2, None), (2, None)]
    got = repeat_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted({(-1 if d is None else d, sha(t), t or "") for d, t in rows})
    want = {(d, s): r for (d, s, _), r in zip(order, plain_removal([t for _, _, t in order]).values(), strict=True)}
    given = sorted((-1 if d is None else d, want[-1 if d is None else d, sha(t)]) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == given


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1060)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: groups.find(x) for e in edges for x in e if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def nearest(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        order = sorted((-round(float(s[j]), 12), int(ids[j])) for j in range(len(ids)) if j != i)[:k]
        out[int(ids[i])] = [j for _, j in order]
    return out


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = neighbours.build_index(rows, shard_rows=200)
    got = defaultdict(list)
    for r in neighbours.search(index, rows.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    table = rows.orderBy("vec_id").toPandas()
    want = nearest(table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64))
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.95


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 120)] + [(200, [0.0, 1.0]), (250, [1.0, 1.0]), (301, None), (302, [0.0, 0.0]), (303, [nan, 1.0]), (304, [1.0, None]), (305, [1.0]), (350, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(neighbours.build_index(vectors), vectors.filter("vec_id % 50 = 0")).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 6)))
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)] and got[50] == [(i, 1.0) for i in (0, 1, 2, 3, 4)]
    assert [v for v, _ in got[200]] == [250, 0, 1, 2, 3] and set(got) == {0, 50, 100, 200, 250}
    none = vectors.filter("false")
    assert neighbours.search(neighbours.build_index(none), none).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "sentencepiece"]
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert kept.count() >= 0.97 * docs.count() and kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = plain_groups({i: shingles(t) for i, t in texts.items()})
    single = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in texts if groups.find(i) == i or not shingles(texts[i]))
    clean = corpus_pipeline.secret_scan(spark, docs, sf_dir)
    assert clean.count() == docs.count() and clean.filter(F.col("text").rlike("[0-9a-f]{16,}")).count() == 0
    assert clean.filter("n_chars != length(text)").count() == docs.filter("n_chars != length(text)").count()
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() > 0 and last.columns == ["doc_id", "lang", "source", "n_ids", "ids"]
