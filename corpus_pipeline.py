"""The corpus pipeline: from documents to token ids, in five stages of which each reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import jaccard_trie, langid, mixing, sentencepiece_codec, suffix_dedup
from docloom.llm.common import crc_mod, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; the model learns from the labelled rows of what it is given."""
    return langid.identified(docs, langid.fit(docs, crc_mod("doc_id", 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-gram Jaccard similarities of 0.8 or more."""
    return jaccard_trie.one_of_each(docs, n=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that start in more than one place and without the passages of more than 50
    words that another document has."""
    return suffix_dedup.without_repeats(docs, length=400, words=suffix_dedup.PASSAGE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's number of ids, and the digests of its ids and of what they decode to."""
    return sentencepiece_codec.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("source_mixing", mixture),
    ("sentencepiece", tokens),
]

#: SQL can't express the language model, the exact tokenizer and the rest of the chain; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
