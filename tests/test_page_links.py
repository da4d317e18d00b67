"""Links of pages, some stored twice under one URL, against the query's SQL."""

import duckdb

import __spark_entry__ as entry

COLUMNS = "url, dst, nav, ord"


def page(menu, rest):
    anchors = lambda hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    return f"<html><body><nav>{anchors(menu)}</nav><p>{anchors(rest)}</p></body></html>"


def both(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in entry.queries()["page_links"](spark, str(tmp_path)).select(*COLUMNS.split(", ")).collect())
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    return got, sorted(duck.execute(f"select {COLUMNS} from ({entry.oracle_sql()['page_links']})").fetchall())


def test_pages_of_one_url_share_their_links(spark, tmp_path):
    """No two links have the same first place, so SQL leaves nothing open: foreign, empty and repeated ones count as places."""
    rows = [
        (1, "https://x.org/a", page(["/n", "/n", "https://other.org/", "", "/m"], ["/r", "/n"])),
        (2, "https://x.org/a", page(["/n", "/k"], ["/n", "/n", "/n", "/n", "/m", "/late", "/r"])),
        (3, "https://x.org/b", page([], ["/r", "/r", "/s"])),
        (4, "https://x.org/c", page([], [])),
    ]
    got, want = both(spark, tmp_path, rows)
    assert got == want and [r[1:] for r in got if r[0].endswith("a")] == [
        ("https://x.org/k", True, 1), ("https://x.org/late", False, 4), ("https://x.org/m", True, 2), ("https://x.org/n", True, 0), ("https://x.org/r", False, 3),
    ]


def test_links_at_one_place_are_in_a_fixed_order(spark, tmp_path):
    """SQL leaves open which of two links at one place is first; the rows but for ``ord``, and its numbers, are the same."""
    rows = [(1, "https://x.org/a", page(["/d", "/a"], ["/e"])), (2, "https://x.org/a", page(["/c", "/b"], ["/a"])), (3, "https://x.org/a", page([], ["/d"]))]
    got, want = both(spark, tmp_path, rows)
    assert [(r[1][-1], r[2], r[3]) for r in sorted(got, key=lambda r: r[3])] == [("c", True, 0), ("d", True, 1), ("a", True, 2), ("b", True, 3), ("e", False, 4)]
    assert [r[:2] for r in got] == [r[:2] for r in want] and sorted(r[3] for r in got) == sorted(r[3] for r in want)
