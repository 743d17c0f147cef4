"""The chain of stages on a small table, each against its operator on its own input."""

import corpus_pipeline
from docloom.llm import jaccard_trie, suffix_dedup


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        if name == "language_id":
            assert out.count() <= docs.count() and out.subtract(docs).isEmpty()
        elif name == "ngram_jaccard_join":
            rows = jaccard_trie.join(docs, n=5, percent=80).collect()
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in rows}
        elif name == "suffix_array_dedup":
            rows = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
            assert all(r.text == rows[r.doc_id].kept.decode(errors="ignore") for r in out.collect())
        elif name == "source_mixing":
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        else:
            assert out.count() == docs.count() and "ids_sha256" in out.columns
            continue
        assert out.columns == columns
        docs = out
