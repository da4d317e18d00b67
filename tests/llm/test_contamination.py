"""Benchmark decontamination against comparison word by word."""

import random
import re
from hashlib import sha256

import pytest

from weftbase.llm import contamination
from weftbase.llm.queries import op13_query

WORD = re.compile(contamination.WORD)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if own := windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None:
                    hit |= {*range(i, i + n)}
                    found |= own
        names = sorted(str(x) if x is not None else "" for x in found)
        out.append((doc_id, len(w), len(hit), len(found), sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()]


def key(r):
    return r[0] is None, r[0] or 0, r[1:]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    voc = ["a", "bb", "Ccc", "dé", "ñandú", "x1", "the", "of", "日本", "ee"]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.choice([10, 11, 15, 25, 40]))) for i in range(30)] + [(100, "the, OF!"), (101, "ee ee ee"), (102, ""), (103, None), (104, "!!"), (7, "a b c other text of the same id"), (None, "no id here at all")]
    items += [(200, items[3][1]), (201, items[3][1].upper())]
    docs = [(i, say(rng.randint(0, 200))) for i in range(60)]
    docs += [(300 + i, f"{say(20)}\n-- {text.replace(' ', rng.choice([' ', ', ', chr(10)]))}; {say(5)}") for i, (_, text) in enumerate(items) if text]
    docs += [(400, None), (401, ""), (402, "the-of"), (403, "ee ee ee ee"), (404, "no id here at all"), (404, "no id here at all"), (None, "THE OF"), (405, "the\x00of the_of"), (406, "theof"), (407, "the of " * 3000)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_equals_brute_force(case):
    docs, bench, raw, items = case
    assert sorted(rows_of(op13_query(docs, bench)), key=key) == sorted(brute(raw, items), key=key)


def test_in_parts_and_small_stretches(case, monkeypatch):
    docs, bench, raw, items = case
    monkeypatch.setattr(contamination, "STRETCH", 7)
    monkeypatch.setattr(contamination, "PIECE", 12)
    monkeypatch.setattr(contamination, "PAIRS", 10)
    assert sorted(rows_of(op13_query(docs, bench, part=800)), key=key) == sorted(brute(raw, items), key=key)


def test_given_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    raw, items = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    got = rows_of(op13_query(docs, bench))
    assert sorted(got, key=key) == sorted(brute(raw, items), key=key)


def test_empty_tables_and_other_columns(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op13_query(none, items).collect() == []
    one = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, hits string, n_words int")
    assert rows_of(op13_query(one, spark.createDataFrame([], "item_id long, text string")))[0][1:4] == (2, 0, 0)
    assert rows_of(op13_query(one, items))[0][1:4] == (2, 2, 1)
    hits = contamination.contaminated(one, items).head()
    assert [tuple(x) for x in hits["hits"]] == [(0, 2)] and hits["items"] == ["1"]
