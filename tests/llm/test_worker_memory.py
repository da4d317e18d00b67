"""Workers outlive their tasks: what they keep of one adds to an executor's memory in all later steps."""

import subprocess
import sys

SCRIPT = """
import re, sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from weftbase.llm import jaccard_join


class Docs:
    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def batches(n):
    random = np.random.default_rng(5)
    for _ in range(n):
        text = random.integers(97, 123, 20_000_000, dtype=np.uint8)
        text[random.integers(0, len(text), len(text) // 6)] = 32
        raw = text.tobytes().decode()
        yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 2500] for i in range(0, len(raw), 2500)])], ["text"])


def rows(n):
    return sum(len(batch) for batch in jaccard_join.prefixes(Docs())(batches(n)))


assert sum(len(batch) for batch in batches(1)) == 8000
before = held()
assert rows(3) > 500_000
print(held() - before)
"""


def test_a_worker_gives_back_what_a_task_has_freed():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout.split()[-1]) < 40


def test_lean_passes_all_batches_on():
    import pyarrow as pa

    from weftbase.llm.textbatch import LARGE, lean

    given = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["n"]) for n in (3, 0, LARGE // 8 + 1)]

    @lean
    def run(batches):
        for batch in batches:
            yield batch.slice(0, 1)
            yield batch.slice(1)

    out = [batch.column("n").to_pylist() for batch in run(iter(given))]
    assert out == [x for batch in given for x in (batch.slice(0, 1).column("n").to_pylist(), batch.slice(1).column("n").to_pylist())]


def test_language_scores_do_not_depend_on_the_size_of_blocks():
    import numpy as np
    import pyarrow as pa

    from weftbase.llm.langid import Model, grams
    from weftbase.llm.textbatch import LEAN, blocks

    texts = pa.array([f"{'ab' * (n % 7)} cd{n} " * 40 for n in range(3000)])
    model = Model({"a": np.unique(grams(next(blocks(texts[:50]))), return_counts=True), "b": np.unique(grams(next(blocks(texts[50:60]))), return_counts=True)})
    large, small = ([model.score(block) for block in blocks(texts, *size)] for size in ((), (LEAN,)))
    assert len(large) < len(small)
    assert np.array_equal(np.concatenate(large), np.concatenate(small))
