"""Literal and edge cases of functions and operators, and loops written from the rules as oracles."""

import random

import pytest
from pyspark.sql import functions as F

from weftbase.functions import answers, citation, doi, text
from weftbase.operators import match, monitor, pages, profile, queue, store


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_fixed_chunk_edges(spark):
    rows = texts(spark, None, "", "a", "x" * 1500, "x" * 1501, "x" * 3000)
    got = [len(r.c) for r in rows.select(text.fixed_chunks(F.col("t")).alias("c"), "i").orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        text.fixed_chunks(F.col("t"), 10, 10)


def loop_chunks(t, size, overlap):
    """The break-aware rules, start by start."""
    out, k, step = [], 0, size - overlap
    while t and (k == 0 or k * step + overlap < len(t)):
        start = k * step
        window = t[start : start + size]
        if start + size < len(t):
            para = window.rfind("\n\n")
            stop = max(window.rfind(m) for m in (". ", "! ", "? "))
            blank = window.rfind(" ")
            if para > size // 2:
                window = window[: para + 2]
            elif stop > size // 2:
                window = window[: stop + 1]
            elif blank >= size // 2:
                window = window[:blank]
        if window.strip(" "):
            out.append(window.strip(" "))
        k += 1
    return out


def test_break_aware_against_loop(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(["a", "b ", ". ", "\n\n", "! ", "é"]) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    rows = texts(spark, *values).select("t", text.break_aware_chunks(F.col("t"), 100, 20).alias("c")).collect()
    for r in rows:
        assert [c.text for c in r.c] == loop_chunks(r.t, 100, 20)


def test_sequential_chunks_cover_the_text(spark):
    rng = random.Random(4)
    value = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "."]) for _ in range(900))
    row = texts(spark, value, None).select(text.sequential_chunks(F.col("t"), 200, 40).alias("c"), text.sequential_chunks(F.col("t"), 200, 40, "paragraph").alias("p")).collect()
    assert all(c.text in value for c in row[0].c) and row[1].c == [] and row[1].p == []
    at = 0
    for c in row[0].c:
        start = value.find(c.text, max(0, at - 60))
        assert start <= at + 1
        at = start + len(c.text)
    assert at == len(value)


STORED = "Agca2016-_EULAR_CVS_update.pdf"
KNOWN = ("agca", "eular", "cvs", "2016")


@pytest.mark.parametrize(
    ("name", "same"),
    [
        (STORED, True), ("20250327145551_" + STORED, True), ("modified_" + STORED, True), ("TEST_" + STORED, True), ("Agca2016_EULAR_CVS_update.pdf", True), ("Agca-EULAR-update.pdf", True),
        ("EULAR_CVS_update.pdf", True), ("Agca2016.pdf", True), ("Agca_2016.pdf", True), ("completely_different_file.pdf", False), ("smolen2018_-_nature_review_primer.pdf", False), ("20250327145551_AgcaSomethingElseEntirely.pdf", False),
    ],
)
def test_duplicate_names(spark, name, same):
    row = one(spark, "a string, b string", (name, STORED)).select(match.is_duplicate(F.col("a"), F.col("b"), KNOWN).alias("d")).first()
    assert row.d is same


@pytest.mark.parametrize(
    ("given", "found"),
    [
        ("see 10.1038/nrdp.2018.1.", "10.1038/nrdp.2018.1"), ("doi: 10.1002/art.41752", "10.1002/art.41752"), ("https://doi.org/10.1093/rheumatology/kez624", "10.1093/rheumatology/kez624"),
        ("10.1016/S0140-6736(20)32279-0", "10.1016/S0140-6736"), ("nothing", None), (None, None),
    ],
)
def test_doi(spark, given, found):
    row = texts(spark, given).select(doi.extract(F.col("t")).alias("s"), doi.extract(F.col("t"), doi.LOOSE).alias("l")).first()
    assert row.s == found
    if given and "(20)" in given:
        assert row.l == "10.1016/S0140-6736(20)32279-0"


def test_answers(spark):
    rows = texts(spark, "a [1][1] b [2][1] c [9]", "none", None, "x [3] y [2]")
    titles = F.array(F.lit("A"), F.lit("B"), F.lit("A"))
    got = [tuple(r) for r in rows.orderBy("i").select(answers.cited(F.col("t")), answers.renumbered(F.col("t"), titles), answers.tidy(F.col("t"))).collect()]
    assert got[0] == ([1, 2, 9], "a [1][1] b [2][1] c ", "a [1] b [2] [1] c [9]")
    assert got[1] == ([], "none", "none") and got[2][1] is None
    assert got[3][1] == "x [2] y [1]"


def test_citation_of_many_authors(spark):
    who = "array<struct<family:string,given:string>>"
    rows = spark.createDataFrame([([("A", "B C")] * n,) for n in (0, 1, 2, 6, 7)], f"a {who}")
    none = F.lit(None).cast("string")
    got = [r.c for r in rows.select(citation.apa(F.col("a"), none, F.lit("T"), none, none, none, none, none).alias("c")).collect()]
    assert got[0] == "(n.d.). T." and got[1] == "A, B.C. (n.d.). T." and got[2] == "A, B.C., & A, B.C. (n.d.). T." and "et al." in got[4] and "et al." not in got[3]


def test_topics(spark):
    rows = texts(spark, '["a", " b "]', "a, ,b", "a\n\nb", "", None)
    got = [r.c for r in rows.orderBy("i").select(text.topics(F.col("t")).alias("c")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], [], None]


def test_loss_alarm(spark):
    counts = [100, 95, 80, 70, 60, 100, 50, 100]
    rows = spark.createDataFrame([(1, i, i, n) for i, n in enumerate(counts)], "store_id long, ts long, event_id long, chunks long")
    got = [(r.healthy, r.in_a_row, r.alert) for r in monitor.loss_alarm(rows).orderBy("ts").collect()]
    assert got == [(True, 0, False), (True, 0, False), (False, 1, False), (False, 2, False), (False, 3, True), (True, 0, False), (False, 1, False), (True, 0, False)]


def test_batch_mode_and_duration(spark):
    rows = spark.createDataFrame([(90.0, 10.0, 59), (10.0, 20.0, 3700), (80.0, 50.0, 90_000)], "c double, m double, s long")
    got = [tuple(r) for r in rows.select(monitor.batch_mode(F.col("c"), F.col("m")).batch_size, monitor.duration_text(F.col("s"))).collect()]
    assert got == [(1, "0m 59s"), (9, "1h 1m"), (2, "1d 1h 0m")]


def test_states(spark):
    rows = texts(spark, '{"total_chunks": 8, "processed_chunks": 3, "status": "processing"}', "broken", None, '{"total_chunks": 0, "processed_chunks": 0, "status": "new"}')
    state = queue.processing_state(F.col("t"))
    got = [tuple(r) for r in rows.orderBy("i").select(state["status"], queue.state_percent(state)).collect()]
    assert got == [("processing", 37), ("unknown", 0), ("unknown", 0), ("new", 0)]


PAGE = "<html><head><title>A &amp; B</title><script>x()</script></head><body><nav><a href='/n?q=1'>N</a></nav><article><h1>Head</h1><p>One <b>two</b>.</p><p>Three</p></article><a href='b/#x'>b</a><a href='https://other.org/'>o</a><a href='javascript:0'>j</a></body></html>"


def test_parse_page():
    title, found, links = pages.parse_page(PAGE, "https://x.org/a/")
    by = {f["method"]: f["text"] for f in found}
    assert title == "A & B" and by["article"] == "Head\nOne two.\nThree" and by["paragraphs"] == "One two.\nThree" and by["headings"].startswith("# Head")
    assert "x()" not in by["body"] and by["navigation"].startswith("Title: A & B\nMenu/Navigation: N")
    assert [(x["href"], x["nav"]) for x in links] == [("https://x.org/n", True), ("https://x.org/a/b/", False)]
    assert pages.parse_page(None, None)[2] == []


def test_crawl_stays_within_bounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("a", "b", False, 0), ("a", "c", True, 1), ("b", "d", False, 0), ("c", "a", False, 0), ("d", "e", False, 0)], "url string, dst string, nav boolean, ord int")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = [(r.url, r.depth) for r in pages.crawl(edges, seeds, max_pages=4).orderBy("ord").collect()]
    assert got == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]


def test_anti_and_semi_make_all(spark, sf_dir):
    from weftbase.plans.fixtures import chunks, entries

    rows = entries(spark, sf_dir)
    valid, orphans = store.split_orphans(rows, chunks(spark, sf_dir).filter("id % 2 = 0"))
    assert valid.count() + orphans.count() == rows.count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id long, file_type string")
    chunks = spark.createDataFrame([], "id long, document_id long")
    done = spark.createDataFrame([], "chunk_id long")
    assert profile.progress(docs, chunks, done).first().percent == 0.0
    assert profile.by_type(docs, chunks).count() == 0


def test_contained_values_against_loop(spark):
    rng = random.Random(5)
    value = lambda low, high: "".join(rng.choice("ab_1") for _ in range(rng.randrange(low, high)))
    needles, hay = [value(0, 11) for _ in range(150)] + [None], [value(0, 40) for _ in range(120)] + [None]
    got = match.contained_values(one(spark, "_n string", *[(n,) for n in needles]), one(spark, "_t string", *[(t,) for t in hay]))
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in set(needles) for t in set(hay) if n and t and n in t)


def test_contained_values_with_one_ending(spark):
    """Names with a common beginning and ending: each is compared only with texts that have its own grams."""
    n = spark.range(3000).select(F.format_string("study_%05d_v2.pdf", F.col("id")).alias("_n"))
    t = n.select(F.concat(F.lit("About "), F.col("_n")).alias("_t"))
    assert match.contained_values(n, t).count() == 3000
    g = match._grams
    grams = t.select("_t", F.explode(g(F.col("_t"), match.GRAM, match.GRAM)).alias("_k"))
    held = grams.groupBy("_k").agg(F.count(F.lit(1)).alias("c"))
    own = n.select("_n", F.explode(g(F.col("_n"), match.GRAM, match.GRAM)).alias("_k"))
    joined = own.join(held, "_k").groupBy("_n").agg(F.min("c").alias("c")).agg(F.sum("c").alias("s")).first().s
    assert joined < 20 * 3000


def test_keyword_values_against_loop(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "the", "study"]
    names = ["_".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + ".pdf" for _ in range(60)]
    titles = [" ".join(rng.choice([*words, "Studying", "alphabet"]) for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    got = match.keyword_values(one(spark, "_n string", *[(n,) for n in names]), one(spark, "_t string", *[(t,) for t in titles]))
    keys = lambda n: {w for w in n[:-4].split("_") if len(w) > 3}
    want = {(n, t.lower()) for n in names for t in titles if sum(w in t.lower() for w in keys(n)) >= 2}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_duplicates_against_pairs(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["Agca", "2016", "EULAR", "cvs", "report", "x", "new_", "20250327145551_"])
    names = ["".join(part() for _ in range(rng.randrange(1, 5))) + ".pdf" for _ in range(70)] + [None, None, ".pdf"]
    rows = one(spark, "id long, filename string", *list(enumerate(names)))
    got = {r.id: r.duplicate_of for r in match.first_duplicates(rows, KNOWN).collect()}
    a, b = rows.select("id", F.col("filename").alias("f")), rows.select(F.col("id").alias("o"), F.col("filename").alias("g"))
    pairs = a.join(b, F.col("o") < F.col("id")).filter(match.is_duplicate(F.col("f"), F.col("g"), KNOWN))
    want = {r.id: r.o for r in pairs.groupBy("id").agg(F.min("o").alias("o")).collect()}
    assert got == {i: want.get(i) for i in range(len(names))} and len(want) > 20


def test_every_rule_of_the_cascade(spark):
    docs = one(spark, "id long, file_path string, filename string, doi string, title string",
               (1, "p/one", "one.pdf", None, None), (2, None, "two-paper.pdf", "10.1/two", "Second"), (3, None, "gout_joint-pain.pdf", None, ""), (4, "p/four", "two-paper.pdf", "10.1/two", None))
    entries = one(spark, "entry_id string, file_path string, filename string, doi string, title string",
                  ("path", "p/one", "two-paper.pdf", None, None), ("name", "", "two-paper.pdf", None, "Second"), ("whole", None, "", None, "see two-paper.pdf"), ("stem", None, None, "10.1/two", "on two-paper"),
                  ("doi", None, None, "10.1/two", "Second"), ("title", None, None, "", "Second"), ("words", None, None, None, "Pain in JOINTs"), ("none", None, None, None, "Pain"), ("blank", "", "", "", ""))
    got = {r.entry_id: (r.rule, r.id) for r in match.cascade(docs, entries).collect()}
    assert got == {"path": (1, 1), "name": (2, 4), "whole": (3, 4), "stem": (4, 4), "doi": (5, 4), "title": (6, 2), "words": (7, 3)}
    assert "words" not in {r.entry_id for r in match.cascade(docs, entries, with_keywords=False).collect()}


def test_every_rule_of_filenames_matches(spark, sf_dir):
    import __spark_entry__ as entry

    assert {r.rule for r in entry.queries()["filename_matches"](spark, sf_dir).select("rule").distinct().collect()} == {1, 2, 3, 4, 5}


def test_failing_embedder(spark):
    from weftbase.operators import embed

    def make():
        import numpy as np

        def run(given):
            if any("bad" in t for t in given):
                raise ValueError("no vector for bad")
            return np.full((len(given), 2), 2.0)

        return run

    rows = texts(spark, "good", "bad", "", None, "good").coalesce(1)
    got = {(r.i): (list(r.vector), r.error) for r in embed.embed_once(rows.withColumnRenamed("t", "text"), make, 2).collect()}
    assert got == {0: ([2.0, 2.0], None), 1: ([0.0, 0.0], "no vector for bad"), 2: ([0.0, 0.0], None), 3: ([0.0, 0.0], None), 4: ([2.0, 2.0], None)}


def test_blocked_terms_without_any(spark):
    rows = one(spark, "entry_id string, title string, file_path string, citation string", ("a", None, None, None), ("b", "Withdrawn work", None, None), ("c", "x", "p/withdrawn", "")).cache()
    left = lambda *terms: sorted(r.entry_id for r in store.without_blocked(rows, one(spark, "term string", *[(t,) for t in terms])).collect())
    assert left() == ["a", "b", "c"] and left("", None) == ["a", "b", "c"] and left("Withdrawn") == ["a", "c"] and left("wn", "x") == ["a"]


def test_ranges_of_queues(spark):
    chunks = spark.range(500).select((F.col("id") * 7 % 500).alias("id"), F.floor(F.col("id") * 7 % 500 / 3).alias("document_id"), (F.col("id") * 7 % 500 % 3).alias("chunk_index"))
    got = {r.id: r.next_id for r in queue.next_chunk(chunks).collect()}
    assert got == {i: i + 1 if i < 499 else None for i in range(500)}
    done = spark.range(0, 500, 5).select(F.col("id").alias("chunk_id"))
    first = sorted(r.id for r in queue.until_target(chunks, done, 50.0).collect())
    assert first == [i for i in range(500) if i % 5][:150]
    assert queue.until_target(chunks, done, 10.0).count() == 0 and queue.until_target(chunks.limit(0), done.limit(0), 50.0).count() == 0


def test_vector_pool_over_shards(spark, monkeypatch):
    import numpy as np

    from weftbase.operators import search

    monkeypatch.setattr(search, "SHARD", 60)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * 1000
    x[100:140] = x[100]
    rows = [(str(i), i, [float(v) for v in x[i]]) for i in range(300)] + [("none", 300, None)]
    entries = one(spark, "entry_id string, pos long, vector array<double>", *rows)
    asked = one(spark, "query_id long, vector array<double>", *[(i, rows[i][2]) for i in (0, 100, 139, 250)])
    got = {}
    for r in search.block_topk(asked, entries, 7).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.pos, r.dist))
    for i, found in got.items():
        d = ((x - x[i]) ** 2).sum(1)
        assert found == [(j, d[j]) for j in sorted(range(300), key=lambda j: (d[j], j))[:7]]
    assert len(got) == 4 and search.block_topk(asked.limit(0), entries, 7).count() == 0 and search.block_topk(asked, entries.limit(0), 7).count() == 0


@pytest.mark.parametrize(
    ("given", "strict", "loose", "cleaned"),
    [
        ("Digital Object Identifier: 10.1000/abc.", "10.1000/abc", "10.1000/abc", "10.1000/abc"), ("D.O.I. 10.1000/abc", "10.1000/abc", "10.1000/abc", "10.1000/abc"), ("doi=10.1000/abc", "10.1000/abc", "10.1000/abc", "10.1000/abc"),
        ("10.1000/plain, https://doi.org/10.1000/linked", "10.1000/linked", "10.1000/plain", "10.1000/plain, https://doi.org/10.1000/linked"), ("cited as 10.1000/in.", "10.1000/in", "10.1000/in", "10.1000/in"), ("doi10.1000/joined", "10.1000/joined", "10.1000/joined", "10.1000/joined"), ("none", None, None, None),
    ],
)
def test_doi_labels_and_order(spark, given, strict, loose, cleaned):
    row = texts(spark, given).select(doi.extract(F.col("t")).alias("s"), doi.extract(F.col("t"), doi.LOOSE).alias("l"), doi.clean(F.col("t")).alias("c")).first()
    assert (row.s, row.l, row.c) == (strict, loose, cleaned)


def test_datacite_edges(spark, tmp_path):
    from weftbase.sources import tables

    path = tmp_path / "works.json"
    path.write_text('{"doi": "10.1/a", "titles": [{"title": "T"}], "publicationYear": 2001}\n{"doi": "10.1/b", "dates": [{"date": "2003-01", "dateType": "Issued"}], "creators": []}\nbroken\n{"titles": []}\n')
    got = {r.doi: (r.title, r.authors, r.publication_year) for r in doi.datacite_fields(tables.read_datacite(spark, str(path))).collect()}
    assert got == {"10.1/a": ("T", None, 2001), "10.1/b": (None, "", 2003)}


def test_authors_and_eta(spark):
    rows = spark.createDataFrame([([("A", "B"), ("C", None)],), ([],), (None,)], "a array<struct<family:string,given:string>>")
    assert [r.c for r in rows.select(citation.author_list(F.col("a")).alias("c")).collect()] == ["A, B; C", "", None]
    row = spark.sql("SELECT timestamp'2025-01-01 23:59:30' AS t, 45 AS s").select(monitor.eta_timestamp(F.col("t"), F.col("s")).cast("string").alias("e")).first()
    assert row.e == "2025-01-02 00:00:15"


def test_chunkers_on_a_very_long_text(spark):
    """Ten million characters take seconds, and every stretch of the grid gives what a loop gives."""
    import time

    value = ("Één zin. " * 7 + "twee\n\n" + "x" * 61) * 75_000
    df = texts(spark, value[:30_000], value)
    began = time.perf_counter()
    fixed = [r.c for r in df.select(F.transform(text.fixed_chunks(F.col("t")), lambda x: F.struct(x["pos"], F.md5(x["text"].cast("binary")).alias("text"))).alias("c")).collect()]
    cut = [r.c for r in df.select(F.transform(text.break_aware_chunks(F.col("t"), 3000, 500), lambda x: F.struct(x["pos"], F.length(x["text"]).alias("n"))).alias("c")).collect()]
    sentences = df.select(F.size(text.sequential_chunks(F.col("t"), 3000, 500))).collect()
    assert time.perf_counter() - began < 40
    from hashlib import md5

    for t, own in zip((value[:30_000], value), fixed, strict=True):
        grid = range(0, max(len(t) - 150, 1), 1350)
        assert [(c.pos, c.text) for c in own] == [(i, md5(t[s : s + 1500].encode()).hexdigest()) for i, s in enumerate(grid)]
    assert len(cut[1]) == -(-(len(value) - 500) // 2500) and all(1500 <= c.n <= 3000 for c in cut[1][:-1]) and sentences[1][0] > 3_000
