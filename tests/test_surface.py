"""Failures as rows, channels that fail, redirects, shards, collections, manifests, and what a terminal or a tool client sees."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docloom import cli, config
from docloom.functions import tokens, urls
from docloom.functions.html_md import attempt, html_to_markdown
from docloom.operators import bm25
from docloom.plans import search, stages, tool
from docloom.sources import crawl, records, sinks

CHUNKS = "id long, title string, version_bucket string, source_md string, heading string, content string, source_url string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"t{k}", "default", "sdk__tools__x", "h", f"install package number {k} " + "rpm " * (k % 4), f"https://d/{k}") for k in range(12)]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(k, [float(k), 1.0], "default") for k in range(12)], "id long, vector array<float>, version_bucket string")


@pytest.mark.parametrize("tag", ["div", "b", "p", "blockquote", "span", "ul><li", "dl><dd", "table><tr><td"])
def test_deep_nesting_is_a_row(tag):
    # What is indented or quoted at each level, or a row of all tables around it, grows with the square of the depth.
    n = {"blockquote": 300, "table><tr><td": 100, "ul><li": 500}.get(tag, 10_000)
    began = time.monotonic()
    md, error = attempt(f"<{tag}>" * n + "deep" + "".join(f"</{t}>" for t in reversed(tag.split("><"))) * n)
    assert error is None and "deep" in md or error == "no content"
    assert time.monotonic() - began < 60


def test_pages_that_fail_are_rows(spark):
    rows = spark.createDataFrame([("a", "<p>x</p>"), ("b", " "), ("c", None), ("d", "<i>" * 5000 + "y")], "url string, html string")
    got = {r.url: r for r in stages.struct_pages(rows).collect()}
    assert (got["a"].status, got["a"].md, got["a"].chars, got["a"].error) == ("ok", "x\n", 2, None)
    assert (got["b"].status, got["b"].error, got["c"].error) == ("error", "no content", "no page")
    assert got["d"].status == "ok" and stages.struct_totals(stages.struct_pages(rows)).first()[:3] == (4, 2, 2)


def test_formatting_reopens():
    assert html_to_markdown("<p><b>x<p>y</b> z") == "**x**\n\n**y** z\n"


def test_a_failing_channel_leaves_the_other(chunks, vectors):
    def broken(_):
        raise OSError("no model")

    rows, said = search.search(chunks, vectors, "install package", broken)
    assert rows.count() == 10 and said["warnings"] == ["dense unavailable: no model"]
    with pytest.raises(search.SearchFailed, match="dense retrieval failed: no model"):
        search.search(chunks, vectors, "install", broken, config.Settings(retrieval_mode="dense"))
    with pytest.raises(search.SearchFailed, match="both channels returned no candidates"):
        search.search(chunks, vectors.limit(0), "zzz", lambda _: [1.0, 0.0])
    with pytest.raises(search.SearchFailed, match="hybrid retrieval failed: dense: no model"):
        search.search(chunks, vectors, "zzz", broken)


def test_hybrid_gives_both_ranks(chunks, vectors):
    rows, said = search.search(chunks, vectors, "install package", lambda _: [1.0, 0.0])
    first = rows.first()
    assert first.dense_rank is not None and first.bm25_rank is not None and first.source_url.startswith("https://d/")
    assert [r["rank"] for r in rows.collect()] == list(range(1, 11)) and not said["no_knowledge"]


def test_one_split_for_each_text(chunks):
    plan = bm25.scores(chunks, "install package rpm", {"content": "content"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_canonical_tokens_lower_once(spark):
    df = spark.range(1).select(tokens.canonical(F.concat(F.lit("Install "), F.col("id").cast("string"))).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1 and df.first().c == ["install"]


def test_redirects(spark):
    pages = {"http://h/a": '<a href="b">x</a><a href="/a">y</a><a href="/out">z</a>', "http://h/dir/b": '<a href="c">x</a>', "http://h/dir/c": "end"}
    moved = {"http://h/b": "http://h/dir/b", "http://h/out": "http://other/"}
    known = spark.createDataFrame([(u, moved.get(u, u), pages.get(moved.get(u, u), "<p>away</p>")) for u in [*pages, *moved]], "url string, final string, html string")

    def fetch(wanted):
        return wanted.join(known, "url", "left").select("url", "html", F.when(F.col("html").isNull(), "not found").alias("error"), "final")

    got = {r.url: r for r in crawl.crawl(spark, "http://h/a", fetch, lambda u: urls.in_scope(u, "h", "/")).collect()}
    assert {u: r.status for u, r in got.items()} == {"http://h/a": "ok", "http://h/b": "ok", "http://h/out": "error", "http://h/dir/c": "ok"}
    assert got["http://h/out"].error.startswith("redirected out of scope") and got["http://h/b"].final_url == "http://h/dir/b"


def test_shards_go_on_after_the_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHARD_ROWS", 5)
    path = f"file://{tmp_path}/v"
    assert sinks.write_shards(spark.range(12).coalesce(1), path, prefix="vectors-") == 3
    assert sinks.write_shards(spark.range(2).coalesce(1), path, append=True, prefix="vectors-") == 1
    assert sorted(p.name for p in (tmp_path / "v").glob("*.jsonl")) == [f"vectors-{k:05d}.jsonl" for k in range(4)]
    assert spark.read.json(f"{path}/*.jsonl").count() == 14 and sinks.next_shard(spark, path, "vectors-") == 4


def test_collection(spark, tmp_path, vectors):
    path = f"file://{tmp_path}/c"
    assert sinks.deploy(vectors, path) == {"size": 2, "distance": "Cosine", "points": 12, "upserted": 12}
    again = vectors.limit(3).withColumn("vector", F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>")).withColumn("version_bucket", F.lit("1.0"))
    assert sinks.deploy(again, path)["points"] == 12
    assert spark.read.parquet(f"{path}/points").filter("vector[0] = 9 and vector[1] = 9").count() == 3
    wide = vectors.withColumn("vector", F.concat("vector", "vector"))
    with pytest.raises(sinks.DimensionMismatch):
        sinks.deploy(wide, path)
    with pytest.raises(sinks.DimensionMismatch):
        sinks.deploy(wide.unionByName(vectors), f"{path}2")
    assert sinks.deploy(wide, path, recreate=True)["size"] == 4


def test_tool_output(chunks, vectors):
    answer = lambda given: tool.call(given, chunks, vectors, lambda _: [1.0, 0.0])
    out = []
    lines = ['{"id": 1, "method": "initialize"}', '{"method": "notifications/initialized"}', '{"id": 2, "method": "tools/list"}', "{broken", '{"id": 3, "method": "nothing"}']
    lines.append(json.dumps({"id": 4, "method": "tools/call", "params": {"name": "search_docs", "arguments": {"query": "install rpm", "with_context": True}}}))
    tool.serve(lines, out.append, answer)
    got = [json.loads(x) for x in out]
    assert [x.get("id") for x in got] == [1, 2, None, 3, 4] and "error" in got[2] and "error" in got[3]
    found = json.loads(got[4]["result"]["content"][0]["text"])
    assert len(found["context"]) == 10 and "context segment(s)" in tool.context_text(found)
    rows, said = search.search(chunks, vectors, "install rpm", lambda _: [1.0, 0.0])
    text = tool.results_text(said, [json.loads(x) for x in rows.toJSON().collect()])
    assert text.startswith("10 results (mode=hybrid") and "   source: https://d/" in text
    assert tool.results_text(said | {"message": None}, []) == "No results found"


def test_verbs(spark, tmp_path):
    page = tmp_path / "site" / "doc" / "5.2" / "sdk" / "index.html"
    page.parent.mkdir(parents=True)
    page.write_text("<article><div class='prose'><h1>Tools</h1><p>" + "Install the package with care. " * 20 + "</p></div></article>")
    go = lambda *args: cli.run(spark, cli.parser().parse_args([*map(str, args)]))
    go("struct", tmp_path / "site", tmp_path / "md")
    go("chunk", tmp_path / "md", tmp_path / "chunks")
    go("embed", tmp_path / "chunks", tmp_path / "vectors")
    assert go("deploy", tmp_path / "vectors", tmp_path / "coll")["points"] > 0
    assert spark.read.json(f"{tmp_path}/md/_manifest").first().converted_total == 1
    assert spark.read.json(f"{tmp_path}/vectors/_manifest").first().vectors_total > 0
    text = go("search_docs", "install package", tmp_path / "chunks", tmp_path / "vectors", "--text")
    assert "version=5.2" in text
    go("config-init", tmp_path / "c.toml")
    assert config.load(str(tmp_path / "c.toml")) == config.Settings()
    assert records.read_optional_json(str(tmp_path / "none.json")) is None and records.text_of(None) == "" and records.text_of(2.5) == "2.5"
