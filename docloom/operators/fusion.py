"""Weighted reciprocal-rank fusion of ranked channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import weight

from .bm25 import ranked


def rrf(dense: DataFrame, bm25: DataFrame, n: int, k: int = 60, dense_weight: float = 1.0, bm25_weight: float = 0.55, payload: tuple[str, ...] = ()) -> DataFrame:
    """id, score, dense_rank, bm25_rank, payload, rank: each id of either channel once; equal scores go by id."""
    k = max(k, 1)
    a = dense.select("id", F.col("rank").alias("dense_rank"), *[F.col(c).alias(f"a_{c}") for c in payload])
    b = bm25.select("id", F.col("rank").alias("bm25_rank"), *[F.col(c).alias(f"b_{c}") for c in payload])
    both = a.join(b, "id", "full_outer")
    score = F.coalesce(weight(dense_weight) / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(weight(bm25_weight) / (k + F.col("bm25_rank")), F.lit(0.0))
    both = both.select("id", score.alias("score"), "dense_rank", "bm25_rank", *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in payload])
    return ranked(both, n)


def dispatch(mode: str, dense: DataFrame | None, bm25: DataFrame | None, n: int, payload: tuple[str, ...] = (), **how: float) -> DataFrame:
    """The channels of a mode; hybrid falls back to the channel that has rows."""

    def alone(rows: DataFrame, name: str) -> DataFrame:
        ranks = {c: (F.col("rank") if c == name else F.lit(None).cast("int")) for c in ("dense_rank", "bm25_rank")}
        return rows.withColumns(ranks).select("id", "score", "dense_rank", "bm25_rank", *payload, "rank")

    if mode == "dense":
        return alone(dense, "dense_rank")
    if mode == "bm25":
        return alone(bm25, "bm25_rank")
    if bm25 is None or (dense is not None and bm25.isEmpty()):
        return alone(dense, "dense_rank")
    if dense is None or dense.isEmpty():
        return alone(bm25, "bm25_rank")
    return rrf(dense, bm25, n, payload=payload, **how)
