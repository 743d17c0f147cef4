"""Exact cosine top-n, and embedding providers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bm25 import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query))) or 1.0
    return dot(vector, q) / (F.sqrt(dot(vector, vector)) * norm)


def top(vectors: DataFrame, query: Sequence[float], n: int, threshold: float = 0.0, version: str | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The n nearest rows; filters go before the limit, and a threshold counts only above 0."""
    if version and version.strip():
        vectors = vectors.filter(F.col("version_bucket") == version.strip())
    found = vectors.withColumn("score", cosine(F.col(vector_col), query))
    if threshold > 0:
        found = found.filter(F.col("score") >= threshold)
    return ranked(found, n, id_col=id_col)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: signed feature hashing of words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(text: Column, model: Callable[[list[str]], np.ndarray], batch: int = 16) -> Column:
    """The model's vector for each text; the model gets `batch` texts at a time and must return as many vectors."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            got: list[list[float]] = []
            for a in range(0, len(texts), batch):
                v = model(texts[a : a + batch])
                if len(v) != len(texts[a : a + batch]):
                    raise ValueError("the model returned another number of vectors")
                got += v.tolist()
            yield pd.Series(got)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)
