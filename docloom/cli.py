"""Verbs over the batch stages and the search: `python -m docloom.cli <verb> ...`."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import urls
from docloom.operators import dense, rerank
from docloom.plans import search, stages, tool
from docloom.sources import crawl, records, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--config")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("struct", "chunk", "embed"):
        v = verbs.add_parser(verb)
        v.add_argument("source")
        v.add_argument("out")
        v.add_argument("--resume", action="store_true")
    v = verbs.add_parser("config-init")
    v.add_argument("out")
    v = verbs.add_parser("fetch-web")
    v.add_argument("seed")
    v.add_argument("out")
    v.add_argument("--prefix", default="/")
    v.add_argument("--depth", type=int, default=crawl.DEPTH)
    v = verbs.add_parser("deploy")
    v.add_argument("source")
    v.add_argument("out")
    v.add_argument("--recreate", action="store_true")
    v.add_argument("--from-bundle", action="store_true")
    v = verbs.add_parser("mcp")
    v.add_argument("chunks")
    v.add_argument("vectors", nargs="?")
    v = verbs.add_parser("bundle")
    v.add_argument("action", choices=("create", "inspect", "extract"))
    v.add_argument("path")
    v.add_argument("root", nargs="?", default=".")
    v = verbs.add_parser("clear")
    v.add_argument("root")
    v.add_argument("stages", nargs="*", default=list(sinks.TARGETS))
    v = verbs.add_parser("search_docs")
    v.add_argument("query")
    v.add_argument("chunks")
    v.add_argument("vectors", nargs="?")
    v.add_argument("--top-k", type=int)
    v.add_argument("--retrieval-mode")
    v.add_argument("--doc-version")
    v.add_argument("--knowledge-threshold")
    v.add_argument("--rerank", action="store_true")
    v.add_argument("--no-rerank", action="store_true")
    v.add_argument("--with-content", action="store_true")
    v.add_argument("--with-context", action="store_true")
    v.add_argument("--text", action="store_true")
    return p


def tables(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    chunks = spark.read.parquet(args.chunks)
    heading = F.array_join("heading_path", " > ").alias("heading")
    links = [c for c in ("source_url", "source_url_with_anchor") if c in chunks.columns]
    chunks = chunks.select("id", F.col("source_title").alias("title"), "version_bucket", "source_md", heading, "content", *links)
    return chunks, spark.read.parquet(args.vectors) if args.vectors else None


def search_docs(spark: SparkSession, args: argparse.Namespace) -> dict | str:
    s = config.load(args.config, top_k=args.top_k, retrieval_mode=args.retrieval_mode, doc_version=args.doc_version, knowledge_threshold=args.knowledge_threshold)
    s = config.replace(s, rerank=config.use_rerank(s.rerank, args.rerank, args.no_rerank))
    model = dense.hashing_embedder()
    rows, said = search.search(*tables(spark, args), args.query, lambda q: model([q])[0].tolist(), s, rerank.overlap_scorer, args.with_content or args.with_context)
    results = [json.loads(x) for x in rows.toJSON().collect()]
    if args.with_context:
        found = tool.contexts(said, results)
        return tool.context_text(found) if args.text else found
    return tool.results_text(said, results) if args.text else said | {"results": results}


def config_init(out: str) -> str:
    """A file of all settings at their defaults; one that is there stays."""
    lines = [f"{f.name} = {json.dumps(f.default)}" for f in fields(config.Settings) if f.default is not None]
    with open(out, "x") as f:
        f.write("\n".join(["[search]", *lines, ""]))
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    began = datetime.now(UTC)

    def ended(totals: DataFrame) -> None:
        sinks.write_manifest(sinks.manifest(totals, args.verb, args.source if "source" in args else args.seed, args.out, began), f"{args.out}/_manifest")

    match args.verb:
        case "config-init":
            return config_init(args.out)
        case "fetch-web":
            host = spark.range(1).select(urls.host(F.lit(args.seed))).first()[0]
            got = crawl.crawl(spark, args.seed, crawl.http_fetcher(), lambda u: urls.in_scope(u, host, args.prefix), args.depth)
            got.withColumn("path", urls.html_file_path(F.col("url"))).write.mode("overwrite").parquet(args.out)
            ended(crawl.totals(spark.read.parquet(args.out)))
        case "struct":
            pages = records.html_tree(spark, args.source).withColumnRenamed("path", "url")
            made = stages.struct_pages(pages).withColumn("__o", urls.output_of(F.regexp_extract("url", "(doc/.*)$", 1)))
            made = made.select("*", F.coalesce("__o.bucket", F.lit("default")).alias("version_bucket"), F.col("__o.file_name").alias("doc_key")).drop("__o")
            made.write.mode("overwrite").partitionBy("version_bucket").parquet(args.out)
            ended(stages.struct_totals(spark.read.parquet(args.out)))
        case "chunk":
            # What struct has written, or Markdown files below buckets.
            files, at = sinks.file_system(spark, f"{args.source}/_SUCCESS")
            docs = records.markdown_buckets(spark, args.source) if not files.exists(at) else spark.read.option("basePath", args.source).parquet(args.source).filter("status = 'ok'").select(F.col("version_bucket").cast("string"), "doc_key", F.col("md").alias("text"))
            stages.chunk(docs).write.mode("overwrite").parquet(args.out)
            ended(stages.chunk_totals(spark.read.parquet(args.out)))
        case "embed":
            chunks = spark.read.parquet(args.source)
            if args.resume:
                chunks = stages.pending(chunks, spark.read.parquet(args.out))
            stages.embed(chunks, dense.hashing_embedder(), "hashing").write.mode("append" if args.resume else "overwrite").parquet(args.out)
            ended(stages.embed_totals(spark.read.parquet(args.out)))
        case "deploy":
            if args.from_bundle:
                return sinks.deploy_bundle(spark, args.source, f"{args.out}-bundle", args.out, args.recreate)
            return sinks.deploy(spark.read.parquet(args.source), args.out, args.recreate)
        case "bundle":
            return {"create": lambda: sinks.bundle(args.root, args.path), "inspect": lambda: sinks.inspect_bundle(args.path), "extract": lambda: sinks.extract_bundle(args.path, args.root)}[args.action]()
        case "clear":
            return sinks.clear(args.root, tuple(args.stages))
        case "mcp":
            model, known = dense.hashing_embedder(), tables(spark, args)
            tool.serve(sys.stdin, lambda x: print(x, flush=True), lambda given: tool.call(given, *known, lambda q: model([q])[0].tolist(), rerank.overlap_scorer, config.load(args.config)))
        case "search_docs":
            return search_docs(spark, args)
    return None


def main() -> None:
    out = run(SparkSession.builder.getOrCreate(), parser().parse_args())
    if isinstance(out, str):
        print(out)
    elif out is not None:
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
