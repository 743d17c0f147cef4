import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import Settings
from docloom.functions.register import register
from docloom.operators import bm25, dense, fusion, quality, rerank
from docloom.plans import catalog, search, stages, tool
from docloom.sources import crawl, records, sinks
from docloom.streaming.resume import embed_new


def test_fusion(spark):
    near = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    words = spark.createDataFrame([("a", 4), ("c", 1)], "id string, rank int")
    rows = fusion.rrf(near, words, 10).collect()
    assert [(r.id, r.dense_rank, r.bm25_rank) for r in rows] == [("a", 1, 4), ("b", 2, None), ("c", None, 1)]
    scored = near.withColumn("score", F.lit(1.0))
    assert [r.id for r in fusion.dispatch("hybrid", scored, scored.limit(0), 5).orderBy("rank").collect()] == ["a", "b"]


def test_rerank(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    scores = spark.createDataFrame([(2, 0.99), (0, 0.55), (5, 0.9)], "idx int, rerank_score double")
    got = rerank.apply(rows, scores).orderBy("final_rank").collect()
    assert [r.id for r in got] == ["c", "a", "b"] and got[2].rerank_rank is None
    answer = json.dumps({"results": [{"index": 0, "relevance_score": 0.2}, {"index": 0, "score": 0.67}, {"index": 1}, {"relevance_score": 1.0}]})
    parsed = rerank.parse_scores(spark.createDataFrame([(answer,)], "json string")).collect()
    assert [(r.idx, r.rerank_score) for r in parsed] == [(0, 0.67)]
    docs = spark.createDataFrame([("T", "5.2.0", "H", "text"), ("T", "", "", "  ")], "t string, v string, h string, c string")
    assert [r[0] for r in docs.select(rerank.document(*map(F.col, "tvhc"))).collect()] == ["Title: T\nVersion: 5.2.0\nHeading: H\ntext", None]

    def broken(query, texts):
        raise RuntimeError("down")

    full = rows.selectExpr("id", "rank", "'t' title", "'1' version_bucket", "'h' heading", "id content")
    assert [r.id for r in rerank.rerank(full, "q", broken).orderBy("final_rank").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="down"):
        rerank.rerank(full, "q", broken, fail_open=False)


def test_channels_push_down(spark):
    rows = spark.createDataFrame([(k, "en" if k % 2 else "fr", [float(k), 1.0]) for k in range(20)], "id long, version_bucket string, vector array<float>")
    found = dense.top(rows, [1.0, 0.0], 3, version="en")
    assert [r.id for r in found.orderBy("rank").collect()] == [19, 17, 15]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    docs = spark.createDataFrame([(1, "b a a"), (2, "a"), (3, None), (4, "c")], "id long, content string")
    assert [r.id for r in bm25.top(docs, "a (", 5).orderBy("rank").collect()] == [2, 1]
    assert bm25.top(docs, "  ", 5).collect() == []


def test_quality(spark):
    rows = spark.createDataFrame([(1, "Install", "x__sdk__tools__y", "install the rpm package"), (2, "t", "sdk__tools", "x")], "rank int, title string, source_md string, content string")
    assert quality.answer_quality(rows, "install package").first().confidence == "high"
    assert quality.answer_quality(rows, "launch it").first().confidence == "low"
    assert quality.answer_quality(rows, "the of").first().confidence == "medium"
    assert quality.answer_quality(rows.limit(0), "x").first().confidence == "low"
    assert quality.gate(rows, "low", "medium").count() == 0 and quality.gate(rows, "low", "low").count() == 2


def test_search(spark):
    model = dense.hashing_embedder(32)
    texts = ["install the rpm package with a tool", "take a screenshot of the screen", "build and sign the application"]
    chunks = spark.createDataFrame([(str(k), "T", "default", f"sdk__tools__{k}", "H", t) for k, t in enumerate(texts)], "id string, title string, version_bucket string, source_md string, heading string, content string")
    vectors = chunks.select("id", "version_bucket", dense.embed(F.col("content"), model).alias("vector"))
    for mode in ("hybrid", "dense", "bm25"):
        rows, said = search.search(chunks, vectors, "install rpm", lambda q: model([q])[0].tolist(), Settings(retrieval_mode=mode, rerank=True, top_k=2), rerank.overlap_scorer)
        assert rows.first().id == "0" and said["confidence"] in ("medium", "high")
    answer = tool.call({"query": "install rpm", "top_k": 1, "with_context": True}, chunks, vectors, lambda q: model([q])[0].tolist())
    assert answer["context"][0]["text"] == texts[0]
    with pytest.raises(ValueError, match="unknown inputs"):
        tool.call({"query": "x", "limit": 1}, chunks, vectors, None)
    gone, said = search.search(chunks, None, "unknown words", settings=Settings(retrieval_mode="bm25", knowledge_threshold="high"))
    assert gone.count() == 0


def test_stages_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([("default", "a__b.md", "# A\n\ntext\n\n" + "word " * 600), ("1.2", "index.md", "x"), ("1.2", "none.md", None)], "version_bucket string, doc_key string, text string")
    chunks = stages.chunk(docs).cache()
    first = chunks.filter("doc_key = 'a__b.md' and chunk_index = 0").first()
    assert first.source_url == "https://docs.example.com/doc/a/b" and first.chunk_count_in_doc == chunks.filter("doc_key = 'a__b.md'").count()
    stats = {r.version_bucket: r for r in stages.chunk_stats(chunks).collect()}
    assert stats["1.2"].chunks == 1 and stats["default"].docs == 1
    vectors = stages.embed(chunks.limit(1), dense.hashing_embedder(8), "hashing")
    assert stages.pending(chunks, vectors).count() == chunks.count() - 1
    assert stages.dim_check(vectors).first().consistent
    shards, out, state = (str(tmp_path / x) for x in ("shards", "out", "state"))
    model = dense.hashing_embedder(8)
    some = chunks.select("id", "content")
    for part in (some.limit(2), some):
        sinks.write_shards(part, shards, append=True)
        embed_new(spark, shards, some.schema, out, state, lambda rows: rows.withColumn("vector", dense.embed(F.col("content"), model)))
    assert spark.read.parquet(out).count() == some.count()


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([('{"id":"a","content":"x"}',), ("[1]",), ("{bad",), ('{"id":" "}',), ('{"id":"b"}',)], "json string")
    assert [(r.id, r.content) for r in records.permissive(rows, "json").orderBy("id").collect()] == [("a", "x"), ("b", "")]
    path = str(tmp_path / "s")
    spark.createDataFrame([("a", None)], "id string, content string").write.json(path)
    with pytest.raises(Exception, match="record without content"):
        records.strict_shards(spark, path, T.StructType().add("id", "string").add("content", "string")).collect()
    totals = spark.createDataFrame([('{"vectors_total":3,"chunks_embedded":4}',), ('{"chunks_embedded":4}',), ("{}",)], "json string")
    assert [r.total for r in records.vectors_total(totals).collect()] == [3, 4, None]
    (tmp_path / "md/default").mkdir(parents=True), (tmp_path / "md/other").mkdir(), (tmp_path / "md/1.2").mkdir()
    for name in ("default/a.md", "other/b.md", "1.2/c.md"):
        (tmp_path / "md" / name).write_text("x")
    assert [r.doc_key for r in records.markdown_buckets(spark, str(tmp_path / "md")).collect()] == ["c.md", "a.md"]


def test_crawl(spark):
    pages = spark.createDataFrame([("http://a.b/", '<a href="/x">x</a><a href="http://c.d/">c</a>'), ("http://a.b/x", '<a href="/y/">y</a><a href="/gone">g</a>'), ("http://a.b/y", "<p>end</p>")], "url string, html string")
    got = {r.url: (r.depth, r.status) for r in crawl.crawl(spark, "http://a.b", crawl.page_fetcher(pages), lambda u: F.contains(u, F.lit("//a.b/"))).collect()}
    assert got == {"http://a.b/": (0, "ok"), "http://a.b/x": (1, "ok"), "http://a.b/y": (2, "ok"), "http://a.b/gone": (2, "error")}
    named = spark.createDataFrame([("u", '<script id="__NEXT_DATA__">{"props":{"pageProps":{"initialState":{"version":{"availableVersions":["5.1","x"]}}}}}</script><a href="/doc/5.2/z">v</a>')], "url string, html string")
    assert [r.version for r in crawl.versions(named, "a.b").collect()] == ["5.1", "5.2"]


def test_bundles(tmp_path):
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks/a").write_text("x")
    (tmp_path / "vectors").mkdir()
    (tmp_path / "vectors/b").write_text("yy")
    out = str(tmp_path / "b.tar.zst")
    assert sinks.bundle(str(tmp_path), out)["total_bytes"] == 3
    assert sinks.inspect_bundle(out)["file_count"] == 2
    assert sinks.extract_bundle(out, str(tmp_path / "o"), only=("vectors",)) == ["vectors/b"]
    assert not sinks.safe("../x") and not sinks.safe("/x")
    assert sinks.clear(str(tmp_path), ("chunk",)) == [str(tmp_path / "chunks")]


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id long, seq long, v string")
    new = spark.createDataFrame([(1, 3, "c")], "id long, seq long, v string")
    assert sorted(r.v for r in sinks.upsert(old, new).collect()) == ["b", "c"]


def test_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a a", "a"), (2, "a", ""), (3, None, "c"), (4, "c", "d")], "id long, content string, title string")
    fields = {"content": "content", "title": "title"}
    path = str(tmp_path / "index")
    for _ in range(2):
        found = bm25.scan(*bm25.index(docs, fields, path), "a c")
    want = {r.id: r.score for r in bm25.scores(docs, "a c", fields).collect()}
    assert {r.id: r.score for r in found.collect()} == pytest.approx(want)
    assert len(list((tmp_path / "index").iterdir())) == 1
    bm25.index(docs.limit(2), fields, path)
    assert len(list((tmp_path / "index").iterdir())) == 2


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("select html_to_md('<p>x</p>') a, cosine(array(1f, 0f), array(1f, 0f)) c").first()[:] == ("x\n", 1.0)
    assert spark.sql("select content from (select '# A\n\nx' t), lateral chunk_md(t, 's')").count() == 1


def test_http_errors_are_rows(spark):
    fetch = crawl.http_fetcher(crawl.HttpClient(timeout=1))
    row = fetch(spark.createDataFrame([("http://127.0.0.1:9/x",)], "url string")).first()
    assert row.html is None and row.error


def test_short_rows_are_dealt_and_chunked_once(spark, tmp_path, monkeypatch):
    d = "/root/testdata/sf0.01"
    assert spark.read.parquet(f"{d}/orders.parquet").rdd.getNumPartitions() < 2
    assert catalog.html_blocks(spark, d).rdd.getNumPartitions() == 2  # 15,000 rows, 10,000 each
    rows = catalog.chunk_kinds(spark, d)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "_chunks" not in plan and "Repartition" in plan


def test_python_gets_batches_bounded_by_bytes(spark):
    was = spark.conf.get(stages.BATCH_BYTES)
    spark.conf.unset(stages.BATCH_BYTES)
    docs = spark.createDataFrame([(k, "word " * 40_000) for k in range(60)], "k long, t string").coalesce(1)
    sizes = stages.bounded(docs).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it), "n long")
    assert max(x.n for x in sizes.collect()) < 6 << 20
    for make in (lambda: stages.chunk(docs.selectExpr("'a' version_bucket", "'b' doc_key", "t text")), lambda: stages.embed(docs.selectExpr("string(k) id", "t content"), dense.hashing_embedder(8), "h"), lambda: stages.struct_pages(docs.selectExpr("k url", "t html"))):
        spark.conf.unset(stages.BATCH_BYTES)
        make()
        assert spark.conf.get(stages.BATCH_BYTES) == stages.MOST
    spark.conf.set(stages.BATCH_BYTES, was)


def test_index_splits_texts_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, None)], "id long, content string").repartition(2)
    calls, was = [], bm25.tokens
    monkeypatch.setattr(bm25, "tokens", lambda c: calls.append(1) or was(c))
    found, stats = bm25.index(docs, {"content": "content"}, f"file://{tmp_path}/once")
    assert len(calls) == 1
    assert [tuple(r) for r in stats.collect()] == [("content", 3.0, 4 / 3)]
    assert sorted((r.term, r.id, r.tf) for r in found.collect()) == [("a", 1, 1), ("b", 1, 2), ("c", 2, 1)]
