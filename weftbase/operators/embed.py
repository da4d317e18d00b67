"""Embedding texts through any vectorised embedder, each distinct text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftbase.functions.text import text_key

Embedder = Callable[[list[str]], np.ndarray]
RESULT = "vector array<float>, error string, seconds double"


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed counts of hashed words, of length 1."""

    def run(texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dim] += 1 if (h >> 16) & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def embedded(text: Column, make: Callable[[], Embedder], dim: int, batch: int = 256) -> Column:
    """struct<vector, error, seconds> of each text. Empty texts get the zero vector. When a batch fails its
    texts go one by one, and those that fail again get the zero vector and the error."""

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        embed = make()
        for texts in parts:
            vectors = np.zeros((len(texts), dim), np.float32)
            errors: list[str | None] = [None] * len(texts)
            took = np.zeros(len(texts))
            filled = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(filled), batch):
                rows = filled[at : at + batch]
                began = time.perf_counter()
                try:
                    vectors[rows] = embed([texts.iloc[i] for i in rows])
                except Exception:
                    for i in rows:
                        try:
                            vectors[i] = embed([texts.iloc[i]])[0]
                        except Exception as e:
                            errors[i] = str(e)[:200]
                took[rows] = (time.perf_counter() - began) / len(rows)
            yield pd.DataFrame({"vector": list(vectors), "error": errors, "seconds": took})

    return run(text)


def embed_once(rows: DataFrame, make: Callable[[], Embedder], dim: int, most: int = 4_000) -> DataFrame:
    """``rows`` (with text) and their vector and error; equal texts are embedded once."""
    keyed = rows.withColumn("_k", text_key(F.coalesce(F.substring("text", 1, most), F.lit(""))))
    one = keyed.select("_k", F.substring("text", 1, most).alias("_t")).dropDuplicates(["_k"])
    made = one.select("_k", embedded(F.col("_t"), make, dim).alias("_r")).select("_k", F.col("_r.vector").alias("vector"), F.col("_r.error").alias("error"))
    return keyed.join(made, "_k").drop("_k")
