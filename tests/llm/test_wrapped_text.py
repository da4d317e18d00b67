"""Paragraphs and passages of texts that are wrapped, at whatever width."""

from weftbase.llm import paragraphs


def wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_wrapped_paragraphs_and_passages(spark):
    own = iter(range(10**6))
    text = lambda n: [f"w{next(own)}" for _ in range(n)]
    whole, passage = text(120), text(120)
    texts = {
        0: wrapped(whole, 12), 1: wrapped(whole, 9), 2: " ".join(whole), 3: "a head\n\n" + wrapped(whole, 12) + "\n\nan end",
        4: wrapped(text(70) + passage + text(80), 12), 5: wrapped(text(90) + passage + text(60), 13), 6: " ".join(text(95) + passage + text(75)),
        7: wrapped(text(150), 12), 8: wrapped(text(150), 12), 9: "\n".join("one short line of a list" for _ in range(3)), 10: "one short line of a list\n\nand another",
    }
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    rows = paragraphs.repeated_text(docs).collect()
    lines = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.removed) for r in rows if r.first_word is None}
    assert lines == {(0, 0): (0, False), (1, 0): (0, True), (2, 0): (0, True), (3, 2): (0, True)}
    found = {}
    for r in rows:
        if r.first_word is not None:
            found.setdefault(r.doc_id, []).append((r.first_word, r.n_words, r.kept_doc_id, r.removed))
    assert set(found) == {4, 5, 6}
    for doc, begin in ((4, 70), (5, 90), (6, 95)):
        assert len(found[doc]) == 1
        first, n, kept, removed = found[doc][0]
        assert begin <= first and first + n <= begin + 120 and n >= 120 - 2 * (paragraphs.PASSAGE - paragraphs.SEED)
        assert kept == 4 and removed == (doc != 4)


def test_passages_across_the_ends_of_lines(spark):
    """A passage of 54 words, in lines of less than 50, stands within other lines of either document."""
    own = iter(range(10**6))
    text = lambda n: [f"w{next(own)}" for _ in range(n)]
    texts, begins = [], []
    for i in range(30):
        passage = text(54)
        for cut in (4 + i, 46 - i):
            before = text(25 + i)
            texts.append("\n".join([" ".join(text(30)), " ".join(before + passage[:cut]), " ".join(passage[cut:] + text(30)), " ".join(text(3))]))
            begins.append((len(before), cut))
    docs = spark.createDataFrame(list(enumerate([*texts, "\n\n".join(" ".join(text(15)) for _ in range(8))])), "doc_id long, text string")
    rows = paragraphs.repeated_text(docs).collect()
    assert {r.doc_id for r in rows} == set(range(60)) and len(rows) == 60
    for r in rows:
        before, cut = begins[r.doc_id]
        first = r.first_word - before if r.paragraph == 1 else r.first_word + cut
        assert r.paragraph in (1, 2) and 0 <= first and first + r.n_words <= 54 and r.n_words >= paragraphs.SEED
        assert r.kept_doc_id == r.doc_id // 2 * 2 and r.removed == (r.doc_id % 2 == 1)
