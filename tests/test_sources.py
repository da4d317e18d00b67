"""Reading records whose fields are strings or lists, logs with broken lines, inventories."""

import json

from weftbase.functions.doi import work_fields
from weftbase.sources import tables


def test_works(spark, tmp_path):
    records = [
        {"DOI": "10.1/A", "title": ["T"], "container-title": ["J"], "author": [{"family": "F", "given": "G"}], "published-print": {"date-parts": [[2001, 2]]}, "volume": "3"},
        {"DOI": "10.1/B", "title": "S", "container-title": "K", "authors": [{"family": "H"}], "created": {"date-parts": [[1999]]}},
    ]
    (tmp_path / "w.json").write_text("\n".join([*map(json.dumps, records), "broken"]))
    rows = {r.doi: r for r in work_fields(tables.read_works(spark, str(tmp_path / "w.json"))).collect()}
    assert rows["10.1/a"].title == "T" and rows["10.1/a"].publication_year == 2001 and rows["10.1/a"].authors == "F, G"
    assert rows["10.1/b"].title == "S" and rows["10.1/b"].journal == "K" and rows["10.1/b"].publication_year == 1999


def test_inventory_and_log(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.pdf").write_bytes(b"x" * 100)
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [r.length for r in tables.pdf_inventory(spark, str(tmp_path), 50).collect()] == [10]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.json").write_text('{"error_type": "e"}\nbroken\n')
    assert tables.read_log(spark, str(tmp_path / "log"), "error_type string").count() == 2
