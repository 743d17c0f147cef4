"""search_docs: both channels, adjustment, fusion, reranking, projection, answer quality and the gate.

Each channel ranks ids alone, in its own pass, and its few rows are held; one more pass fetches the candidates' payload.
All that follows works on those rows, `top_n` + `bm25_top_n` at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.context import compact_column
from docloom.functions.tokens import expand, shorten
from docloom.operators import bm25, dense, fusion, quality, rerank

PAYLOAD = ("title", "version_bucket", "source_md", "heading", "content")
FIELDS = {"content": "content", "title": "title", "heading": "heading"}
SHOWN = 280


class SearchFailed(RuntimeError):
    """No channel of the mode gave candidates."""


def expanded(spark, query: str) -> str:
    return spark.range(1).select(expand(F.lit(query))).first()[0]


def channel(run: Callable[[], DataFrame | None]) -> tuple[DataFrame | None, Exception | None, int]:
    """(its rows, held; the error that ended it; milliseconds it took)."""
    began = time.monotonic()
    try:
        rows = run()
        found, error = None if rows is None else bm25.held(rows), None
    except Exception as e:  # the other channel may still answer
        found, error = None, e
    return found, error, round(1000 * (time.monotonic() - began))


def candidates(mode: str, near: DataFrame | None, words: DataFrame | None, errors: dict[str, Exception], n: int, **how: float) -> tuple[DataFrame, list[str]]:
    """(the mode's candidates, warnings). A mode of one channel fails with it; hybrid goes on with the channel that has
    candidates and fails if none has."""
    if mode != "hybrid":
        if mode in errors:
            raise SearchFailed(f"{mode} retrieval failed: {errors[mode]}") from errors[mode]
        return fusion.dispatch(mode, near, words, n, PAYLOAD), []
    empty = [x is None or x.isEmpty() for x in (near, words)]
    if all(empty):
        reasons = "; ".join(f"{k}: {e}" for k, e in errors.items()) or "both channels returned no candidates"
        raise SearchFailed(f"hybrid retrieval failed: {reasons}")
    said = [f"{k} unavailable: {e}" for k, e in errors.items()]
    if any(empty):
        return fusion.dispatch("bm25" if empty[0] else "dense", near, words, n, PAYLOAD), said
    return fusion.dispatch(mode, near, words, n, PAYLOAD, **how), said


def search(chunks: DataFrame, vectors: DataFrame | None, query: str, embed: Callable[[str], Sequence[float]] | None = None, settings: Settings | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None, with_content: bool = False) -> tuple[DataFrame, dict]:
    """(results, response). chunks(id, *PAYLOAD, more); vectors(id, vector, version_bucket). Retrieval uses the expanded
    query; adjustment, reranking and quality use the query as it is. An error in one channel leaves the other."""
    s = (settings or Settings()).sane()
    wide = expanded(chunks.sparkSession, query)
    if s.retrieval_mode == "dense" and (vectors is None or embed is None):
        raise ValueError("no channel to search")

    def by_vector() -> DataFrame | None:
        if vectors is None or embed is None:
            return None
        return dense.top(vectors, embed(wide), s.top_n, s.score_threshold, s.doc_version).select("id", "score", "rank")

    def by_words() -> DataFrame:
        rows = bm25.top(chunks.select("id", *PAYLOAD), wide, s.bm25_top_n, FIELDS, s.doc_version)
        return bm25.adjusted(bm25.held(rows.select("id", "score", "rank", "source_md")), query)

    found, errors, took = {}, {}, {}
    for name, run in (("dense", by_vector), ("bm25", by_words)):
        if s.retrieval_mode in ("hybrid", name):
            found[name], error, took[name] = channel(run)
            if error is not None:
                errors[name] = error
    ids = [x.select("id") for x in found.values() if x is not None]
    if ids:
        wanted = (ids[0].union(ids[1]) if len(ids) > 1 else ids[0]).distinct()
        more = [c for c in ("source_url", "source_url_with_anchor") if c in chunks.columns]
        payload = bm25.held(chunks.select("id", *PAYLOAD, *more).join(F.broadcast(wanted), "id"))  # the candidates alone
        found = {k: x if x is None else x.select("id", "score", "rank").join(payload.drop(*more), "id") for k, x in found.items()}
    how = {"k": s.rrf_k, "dense_weight": s.dense_weight, "bm25_weight": s.bm25_weight}
    rows, said = candidates(s.retrieval_mode, found.get("dense"), found.get("bm25"), errors, s.top_n, **how)
    order = "rank"
    if scorer is not None and s.rerank:
        rows, order = rerank.rerank(rows, query, scorer, s.rerank_fail_open), "final_rank"
    results = rows.orderBy(order).limit(s.top_k)
    if ids and more:
        results = results.join(payload.select("id", *more), "id").orderBy(order)
    results = bm25.held(results)
    verdict = quality.answer_quality(results, query, order).first()
    if with_content:
        results = results.withColumn("content", compact_column(F.col("content")))
    else:
        results = results.withColumn("content", shorten(F.col("content"), SHOWN))
    kept = quality.gate(results, verdict["confidence"], s.knowledge_threshold).orderBy(order)
    cut = verdict["n"] > 0 and quality.withheld(verdict["confidence"], s.knowledge_threshold)
    answer = {"query": query, "retrieval_query": wide, "doc_version": s.doc_version, "retrieval_mode": s.retrieval_mode, "knowledge_threshold": s.knowledge_threshold}
    answer |= {"dense_latency_ms": took.get("dense"), "bm25_latency_ms": took.get("bm25"), "rerank_applied": order == "final_rank", "warnings": said}
    return kept, verdict.asDict() | answer | {"no_knowledge": cut, "message": quality.message(s.doc_version) if cut else None}
