"""The conversation trie against sets of prefixes, and its radix tree."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from weftbase.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = [x[2:] for x in sorted(own.get(c - c % 5, []))[:h] + sorted(turns)[h:]]
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def built(df, **how):
    made = pt.prefix_trie(pt.rebuilt(pt.turns_of(df)), **how)
    return sorted((tuple(r[c] for c in COLUMNS) for r in made.collect()), key=lambda r: (r[1], r[0]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["", "a", "bé", "日本語", "long " * 20]
    out = []
    for c in [*range(60), 77, 123, 10**9, -7]:
        kind = rng.random()
        n = 0 if kind < 0.05 else rng.randint(1, 14)
        say = [("user" if i % 2 == 0 else "assistant", "same" if kind < 0.5 else rng.choice(texts)) for i in range(max(n, 1))]
        out += [(c, i if rng.random() < 0.95 or i else None, role, text) for i, (role, text) in enumerate(say)]
    out += [(200, 0, None, None), (201, 0, "", ""), (202, None, "user", None), (None, 0, "user", "no conversation")]
    out += [(c, i, "user", "copy") for c in range(300, 340) for i in range(10)]
    out += [(c, i, "user", f"{i // 40}{'abc'[i % 3]}") for c in (400, 401) for i in range(120)]
    return out


@pytest.mark.parametrize("range_turns", [10**6, 40])
def test_equals_brute_force(spark, rows, range_turns, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert built(df, range_turns=range_turns) == brute(rows)


def test_given_table_in_ranges(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert built(df, range_turns=15) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_repeated_and_other_columns(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    twice = [(5, 0, "u", "a"), (5, 0, "u", "a"), (5, 1, "u", "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in twice], SCHEMA + ", depth int, key string")
    assert built(df) == brute(twice)


def test_layouts_grow():
    for n in (3, 5, 17, 49, 256):
        tree = pt.Tree()
        for b in reversed(range(n)):
            tree.insert(bytes([b, 7]), (b,))
            tree.insert(bytes([b, 7]), (b, "again"))
        assert tree.root.places == min(x for x in (4, 16, 48, 256) if x >= n)
        assert [k.path[0] for k in tree.root.children()] == list(range(n))
        assert all(tree.root.child(b).value == (b, "again") for b in range(n))
        assert n == 256 or tree.root.child(n) is None
    tree = pt.Tree()
    for key in (b"abcdef", b"abc", b"abcxyz", b""):
        tree.insert(key, (key,))
    assert tree.root.value == (b"",) and tree.root.child(97).path == b"abc" and tree.root.child(97).value == (b"abc",)
