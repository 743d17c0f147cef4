"""Readers: page trees, Markdown buckets, JSON shards, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import urls

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "version_bucket", "source_title", "heading_path", "content")])


def html_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, html of every index.html below root, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "index.html").load(root)
    return files.select("path", F.col("content").cast("string").alias("html")).orderBy("path")


def markdown_buckets(spark: SparkSession, root: str) -> DataFrame:
    """version_bucket, doc_key, text of <root>/<default or version>/*.md."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.md")
    bucket, name = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    rows = files.select(bucket.alias("version_bucket"), name.alias("doc_key"), F.col("content").cast("string").alias("text"))
    return rows.filter((F.col("version_bucket") == "default") | urls.is_version(F.col("version_bucket"))).orderBy("version_bucket", "doc_key")


def strict_shards(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ("id", "content")) -> DataFrame:
    """JSON shards in which every record must parse and have the required fields; a bad one ends the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"record without {c}")).cast(schema[c].dataType)).otherwise(F.col(c)))
    return rows


def permissive(rows: DataFrame, column: str, schema: T.StructType = RECORD, key: str = "id") -> DataFrame:
    """Records of JSON texts: texts that aren't objects and those with a blank key are skipped, other fields default to ''."""
    text = F.trim(F.col(column))
    parsed = rows.filter(F.startswith(text, F.lit("{"))).withColumn("__r", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    filled = [F.coalesce(f"__r.{f.name}", F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name != key else F.col(f"__r.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.filter(F.trim(F.col(f"__r.{key}").cast("string")) != "").select(*[c for c in rows.columns if c != column], *filled)


def read_optional_json(path: str) -> dict | None:
    """The object in a JSON file on the driver, null where there is no file; a broken file is an error."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else None


def text_of(value: object) -> str:
    """A JSON scalar as text: strings as they are, null and missing as '', other values as JSON has them."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def vectors_total(manifest: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and the count in a manifest: vectors_total, else chunks_embedded, else null."""
    return manifest.select(*keep, F.coalesce(F.get_json_object(column, "$.vectors_total"), F.get_json_object(column, "$.chunks_embedded")).cast("long").alias("total"))


def existing_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string").json(path).filter("trim(id) <> ''").distinct()
