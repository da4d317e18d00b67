"""What a removal takes, counted by cause, and that it is what without_documents leaves out."""

from weftbase.operators import store

SCHEMA = "entry_id string, document_id long, file_path string"
ROWS = [
    ("a", 1, "p1"), ("b", 1, None), ("c", 2, "p1"), ("d", 2, "p2"), ("e", 3, None), ("f", None, "p1"), ("g", None, None), (None, 4, "p3"),
]


def test_removed_by_cause(spark):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    gone = entries.filter("document_id = 1")
    got = sorted((r["entry_id"], r["cause"]) for r in store.removal(entries, gone.unionByName(gone)).collect())
    assert got == [("a", "named"), ("b", "named"), ("c", "path"), ("f", "path")]
    left = store.without_documents(entries, spark.createDataFrame([(1,)], "id long"))
    assert {r["entry_id"] for r in left.collect()} == {r[0] for r in ROWS} - {"a", "b", "c", "f"}
    counts = {r["cause"]: r["n"] for r in store.removed_counts(entries, gone).collect()}
    assert counts == {"named": 2, "path": 2}
    by = sorted((str(r["document_id"]), r["cause"], r["n"]) for r in store.removed_counts(entries, gone, "document_id").collect())
    assert by == [("1", "named", 2), ("2", "path", 1), ("None", "path", 1)]


def test_nothing_named(spark):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    assert store.removed_counts(entries, entries.filter("document_id = 9")).count() == 0
    assert store.removed_counts(entries.limit(0), entries).count() == 0
    nulls = entries.filter("entry_id is null or file_path is null")
    got = sorted(r["entry_id"] for r in store.removal(entries, nulls.filter("document_id is null or document_id = 3")).collect())
    assert got == ["e", "g"]
