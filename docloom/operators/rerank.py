"""Reranking: documents for a scorer, its answer's scores, and the new order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ANSWER = "struct<results: array<struct<index: bigint, relevance_score: double, score: double>>, data: array<struct<index: bigint, relevance_score: double, score: double>>>"


def document(title: Column, version: Column, heading: Column, content: Column) -> Column:
    """The text that a scorer sees; null for blank content."""

    def line(name: str, value: Column) -> Column:
        return F.when(F.trim(value) != "", F.concat(F.lit(f"{name}: "), F.trim(value)))

    return F.when(F.trim(content) != "", F.concat_ws("\n", line("Title", title), line("Version", version), line("Heading", heading), F.trim(content)))


def parse_scores(answers: DataFrame, column: str = "json", by: tuple[str, ...] = ()) -> DataFrame:
    """by, idx, rerank_score of scorers' JSON answers: the best score of each index; rows without one are dropped."""
    rows = answers.select(*by, F.from_json(column, ANSWER).alias("a"))
    rows = rows.select(*by, F.explode(F.coalesce("a.results", "a.data")).alias("r"))
    rows = rows.select(*by, F.col("r.index").alias("idx"), F.coalesce("r.relevance_score", "r.score").alias("rerank_score"))
    return rows.filter((F.col("idx") >= 0) & F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score")).groupBy(*by, "idx").agg(F.max("rerank_score").alias("rerank_score"))


def apply(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates(rank, ...) by scores(idx from 0, rerank_score): scored ones first, the others in their old order."""
    joined = candidates.join(scores, F.col("idx") == F.col("rank") - 1, "left").drop("idx")
    order = Window.orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return joined.withColumn("final_rank", F.row_number().over(order)).withColumn("rerank_rank", F.when(F.col("rerank_score").isNotNull(), F.col("final_rank")))


def score(query: str, text: Column, model: Callable[[str, list[str]], list[float]], batch: int = 32) -> Column:
    """A cross-encoder's score of (query, text); null for null texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            some = part[part.notna()]
            got = [x for a in range(0, len(some), batch) for x in model(query, some.iloc[a : a + batch].tolist())]
            yield pd.Series(got, some.index, float).reindex(part.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())(text)


def rerank(candidates: DataFrame, query: str, model: Callable[[str, list[str]], list[float]], fail_open: bool = True) -> DataFrame:
    """candidates(rank, title, version_bucket, heading, content, ...) in the scorer's order; if it fails, in their own."""
    doc = document(F.col("title"), F.col("version_bucket"), F.col("heading"), F.col("content"))
    try:
        scored = candidates.select((F.col("rank") - 1).alias("idx"), score(query, doc, model).alias("rerank_score")).filter("rerank_score is not null")
        rows = scored.collect()  # top_n candidates at most
    except Exception:
        if not fail_open:
            raise
        rows = []
    return apply(candidates, candidates.sparkSession.createDataFrame(rows, "idx int, rerank_score double"))


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a model: the share of the query's words in a text."""
    q = set(query.lower().split())
    return [len(q & set(t.lower().split())) / max(1, len(q)) for t in texts]
