"""How well results answer a query, and the gate on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import LEVELS
from docloom.functions.tokens import canonical, coverage, haystack, required_action

from .bm25 import actionable

FIRST, LEAST, MOST, ENOUGH = 5, 0.58, 0.9, 2


def answer_quality(results: DataFrame, query: str, order: str = "rank") -> DataFrame:
    """One row about the first results(title, source_md, content): n, coverage, supported, actionable, confidence."""
    q = canonical(F.lit(query))
    own = canonical(haystack(F.col("title"), F.col("source_md"), F.col("content")))
    action = required_action(q)
    rows = results.orderBy(order).limit(FIRST).select(coverage(q, own).alias("c"), (action.isNull() | F.array_contains(own, F.coalesce(action, F.lit("")))).alias("a"), actionable(F.col("source_md")).alias("s"))
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("c"), F.lit(0.0)).alias("coverage"), F.coalesce(F.bool_or("a"), F.lit(False)).alias("supported"), F.count_if("s").alias("actionable"))
    level = F.when(F.col("n") == 0, "low").when(F.size(q) == 0, "medium").when(~F.col("supported"), "low").when(F.col("coverage") < LEAST, "low")
    return out.withColumn("confidence", level.when((F.col("coverage") >= MOST) & (F.col("actionable") >= ENOUGH), "high").otherwise("medium"))


def withheld(confidence: str, threshold: str) -> bool:
    return LEVELS.index(confidence) < LEVELS.index(threshold)


def gate(results: DataFrame, confidence: str, threshold: str) -> DataFrame:
    """No results where the confidence is below the threshold; `low` lets everything through."""
    return results.limit(0) if withheld(confidence, threshold) else results


def message(version: str | None) -> str:
    """What is said instead of results."""
    return f"No reliable knowledge found for version {version}." if version else "No reliable knowledge found."
