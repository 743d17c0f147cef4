"""search_docs as a tool: a schema of its inputs, and a function from inputs to a JSON-ready answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from docloom.config import LEVELS, MODES, Settings, choice, replace
from docloom.plans.search import search

INPUTS = {
    "type": "object",
    "required": ["query"],
    "properties": {
        "query": {"type": "string"},
        "doc_version": {"type": "string"},
        "top_k": {"type": "integer", "minimum": 1},
        "retrieval_mode": {"enum": list(MODES)},
        "knowledge_threshold": {"enum": list(LEVELS)},
        "rerank": {"type": "boolean"},
        "with_content": {"type": "boolean"},
        "with_context": {"type": "boolean"},
    },
}


def results_text(said: dict, results: list[dict]) -> str:
    """An answer for a terminal: a line about the search, then a line for each result with its source and content."""
    if not results:
        return said.get("message") or "No results found"
    show = lambda v, form="{}": "-" if v is None or v == "" else form.format(v)
    lines = [f"{len(results)} results (mode={said['retrieval_mode']}, dense={show(said['dense_latency_ms'], '{}ms')}, bm25={show(said['bm25_latency_ms'], '{}ms')}, rerank={said['rerank_applied']}, confidence={said['confidence']})"]
    lines += [f"note: {w}" for w in said["warnings"]]
    for k, r in enumerate(results, 1):
        ranks = f"dense_rank={show(r.get('dense_rank'))} bm25_rank={show(r.get('bm25_rank'))}"
        lines.append(f"{k}. score={r['score']:.4f} rerank={show(r.get('rerank_score'), '{:.4f}')} {ranks} version={show(r.get('version_bucket'))} title={show(r.get('title'))}")
        lines += source_lines(r)
        if r.get("content"):
            lines.append("   content: " + r["content"].replace("\n", " "))
    return "\n".join(lines)


def source_lines(result: dict) -> list[str]:
    link = result.get("source_url") if result.get("source_url_with_anchor") is None else result["source_url_with_anchor"]
    return [f"   source: {link}"] if link else []


def contexts(said: dict, results: list[dict]) -> dict:
    """What a prompt needs of an answer: the segments that have content."""
    names = ("title", "source_url", "source_url_with_anchor", "source_md", "version_bucket", "heading")
    kept = [{n: r[n] for n in names if n in r} | {"id": r["id"], "text": r["content"].strip()} for r in results if (r.get("content") or "").strip()]
    return {k: said[k] for k in ("query", "doc_version", "knowledge_threshold", "no_knowledge", "message")} | {"context": kept}


def context_text(answer: dict) -> str:
    if not answer["context"]:
        return answer["message"] or "No context found"
    lines = [f"{len(answer['context'])} context segment(s) for query=\"{answer['query']}\""]
    for k, c in enumerate(answer["context"], 1):
        lines += [f"{k}. {c.get('title') or '-'}", *source_lines(c), "   content: " + c["text"].replace("\n", " ")]
    return "\n".join(lines)


def serve(lines, write: Callable[[str], None], answer: Callable[[dict], dict]) -> None:
    """The tool as JSON-RPC over lines: initialize, tools/list and tools/call; an error is an answer, not the end."""
    for line in lines:
        if not line.strip():
            continue
        asked: dict = {}
        try:
            asked = json.loads(line)
            params = asked.get("params") or {}
            match asked.get("method"):
                case "initialize":
                    result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "docloom"}, "capabilities": {"tools": {}}}
                case "tools/list":
                    result = {"tools": [{"name": "search_docs", "inputSchema": INPUTS}]}
                case "tools/call" if params.get("name") == "search_docs":
                    result = {"content": [{"type": "text", "text": json.dumps(answer(params.get("arguments") or {}), ensure_ascii=False, default=str)}]}
                case _ if "id" not in asked:
                    continue  # a notification
                case other:
                    raise ValueError(f"unknown request: {other}")
            write(json.dumps({"jsonrpc": "2.0", "id": asked.get("id"), "result": result}, ensure_ascii=False))
        except Exception as e:
            write(json.dumps({"jsonrpc": "2.0", "id": asked.get("id") if isinstance(asked, dict) else None, "error": {"code": -32000, "message": str(e)}}))


def call(inputs: dict, chunks: DataFrame, vectors: DataFrame | None, embed: Callable[[str], Sequence[float]] | None, scorer: Callable[[str, list[str]], list[float]] | None = None, settings: Settings | None = None) -> dict:
    """The answer to one call; inputs that the schema doesn't have are an error, those left out keep their settings."""
    if unknown := set(inputs) - set(INPUTS["properties"]):
        raise ValueError(f"unknown inputs: {sorted(unknown)}")
    if not str(inputs.get("query") or "").strip():
        raise ValueError("query is empty")
    s = settings or Settings()
    s = replace(
        s,
        doc_version=inputs.get("doc_version", s.doc_version),
        top_k=inputs.get("top_k") or s.top_k,
        retrieval_mode=choice(inputs.get("retrieval_mode"), MODES, s.retrieval_mode),
        knowledge_threshold=choice(inputs.get("knowledge_threshold"), LEVELS, s.knowledge_threshold),
        rerank=inputs.get("rerank", s.rerank),
    )
    whole = bool(inputs.get("with_content") or inputs.get("with_context"))
    rows, said = search(chunks, vectors, inputs["query"], embed, s, scorer, whole)
    results = [json.loads(x) for x in rows.toJSON().collect()]  # top_k rows at most
    if inputs.get("with_context"):
        return contexts(said, results)
    return said | {"results": results}
