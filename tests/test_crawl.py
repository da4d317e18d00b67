"""Crawls over stored links against a loop of one seed at a time."""

import random

from weftbase.operators import pages

LINKS = "url string, dst string, nav boolean, ord int"


def looped(links, seed, most, keywords):
    """[(url, depth, ord)] of one seed."""
    seen, frontier, out, depth = [seed], [seed], [(seed, 0, 0)], 0
    while frontier and len(seen) < most:
        depth, best = depth + 1, {}
        for url, dst, nav, place in links:
            if url in frontier and dst is not None and dst not in seen:
                key = (not any(k in dst.lower() for k in keywords), not nav, place, dst)
                best[dst] = min(best.get(dst, key), key)
        frontier = sorted(best, key=best.get)[: most - len(seen)]
        out += [(u, depth, len(seen) + i) for i, u in enumerate(frontier)]
        seen += frontier
    return out


def crawled(spark, links, seeds, most, keywords, keep=None):
    rows = pages.crawl(spark.createDataFrame(links, LINKS), spark.createDataFrame([(s,) for s in seeds], "url string"), most, keywords, keep).collect()
    out = {}
    for r in rows:
        out.setdefault(r.seed, []).append((r.url, r.depth, r.ord))
    return {s: sorted(v, key=lambda x: x[2]) for s, v in out.items()}


def test_crawl_against_loop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(11)
    urls = [f"https://h/{'Topic/' if i % 7 == 0 else ''}{i}" for i in range(60)]
    links = [(rng.choice(urls), rng.choice(urls), rng.random() < 0.3, rng.randrange(9)) for _ in range(150)]
    links += [(urls[0], u, False, i) for i, u in enumerate(urls)]  # a hub with more links than a crawl has pages
    links += [(u, urls[0], True, 3) for u in urls[::2]]  # many seeds reach it at once
    links += links[:20] + [(urls[1], None, False, 0), (None, urls[2], False, 0)]
    for most in (1, 4, 25):
        got = crawled(spark, links, urls, most, ("topic",))
        assert got == {u: looped(links, u, most, ("topic",)) for u in urls}


def test_rounds_write_their_own_pages_only(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = [(f"u{i}", f"u{i + 1}", False, 0) for i in range(12)]
    written = []

    def keep(df):
        done = df.checkpoint()
        if "depth" in done.columns:
            written.append(done.count())
        return done

    got = crawled(spark, chain, ["u0", "u10", "elsewhere"], 6, (), keep)
    assert [len(got[s]) for s in ("u0", "u10", "elsewhere")] == [6, 3, 1]
    assert written == [3, 2, 2, 1, 1, 1]


def test_no_seeds_no_links(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert crawled(spark, [], [], 5, ()) == {}
    assert crawled(spark, [], [None, "a", "a"], 5, ()) == {None: [(None, 0, 0)], "a": [("a", 0, 0)]}
