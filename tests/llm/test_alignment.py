"""Cross-tokenizer alignment against whole-text encodings, pair by pair."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from weftbase.llm import alignment
from weftbase.llm.queries import BYTES, PIECES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(rows, encoders):
    """Whole texts encoded at once; every pair of tokens compared."""
    a, sp = encoders
    of = alignment.byte_characters()
    made, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        e = a.encode(" " + (text or ""), add_special_tokens=False)
        ta = [(i, bytes(of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)] if text else []
        tb = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if not text or b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            made.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for tokens in (ta, tb):
            at, own = 0, []
            for i, x in tokens:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(x[2]) for x in own if low < x[1] <= high) for own in spans))
            low = high
        made.append((doc_id, len(ta), len(tb), len(both), links, sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, ng, links, sha in made]


ODD = [
    None, "", " ", "  ", "a", " a b", "a  b\n é中文😀 x", "tail ", "tab\tand\r\nlines\n\n end", "<|endoftext|> <s> </s> <unk>", "x▁y is no blank", "ünï çödé ñandú",
    "\U000131ac rare  chars", "no break 　wide em space", "it's we'll 12345 67,8 !!! ...", "a\x00b \x01 \x7f c", "“quoted” — dash – ok", "ab" * 300, "the the the the", "मानक हिन्दी", "مرحبا بالعالم", "á é combining",
]


def test_alignment_equals_brute_force(spark, sf_dir, encoders):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate([*ODD, *texts, "the the the the"])] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, BYTES, PIECES).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, encoders), key=key)


def test_units_and_memory_of_any_size(spark, monkeypatch, encoders):
    rows = [(i, t * (1 + i % 3)) for i, t in enumerate(t for t in ODD if t)]
    monkeypatch.setattr(alignment, "UNIT", 40)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    monkeypatch.setattr(alignment, "ENCODED", 3)
    aligner = alignment._aligner(alignment._files(BYTES, PIECES))
    import numpy as np
    import pyarrow as pa

    from weftbase.llm.textbatch import blocks

    found = []
    for block in blocks(pa.array([t for _, t in rows]), 40):
        chunk, at = aligner.chunks(block)
        found += [int(aligner.known.counts[chunk[at[d] : at[d + 1]], 3].sum()) if aligner.known.good[chunk[at[d] : at[d + 1]]].all() else 0 for d in range(len(block))]
    assert found == [r[4] for r in brute(rows, encoders)]
    assert len(np.unique(list(aligner.known.index.values()))) == len(aligner.known.index)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, BYTES, PIECES).collect() == []
    other = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, unit long, n_links string")
    row = alignment.align(other, BYTES, PIECES).head()
    assert (row["n_links"], row["n_best"], row["count_sum"]) == (2, 2, 2)
    groups = alignment.groups(other, BYTES, PIECES).head()["groups"]
    assert len(groups) == 2 and all(len(g["a"]) == len(g["b"]) == 1 for g in groups)


def test_bytes_a_remembered_chunk():
    """What a worker keeps of a chunk beside its links and group texts: a few numbers, no objects of Python."""
    import tracemalloc

    import pyarrow as pa

    from weftbase.llm.textbatch import blocks

    aligner = alignment.Aligner(*alignment._files(BYTES, PIECES))
    (block,) = blocks(pa.array([" ".join(f"w{i}" for i in range(30_000))]))
    tracemalloc.start()
    aligner.chunks(block)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    n, known = len(aligner.known.index), aligner.known
    from weftbase.llm import textbatch

    rest = known.links.nbytes + len(b"".join(known.texts(np.arange(n)))) + sum(x.nbytes for x in textbatch._powers.values())
    assert n == 30_000 and held - rest < 120 * n
