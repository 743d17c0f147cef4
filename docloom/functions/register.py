"""Python functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunking import CHUNK, _chunks, _row, chunks
from .context import _compact
from .html_md import _links, _markdown


class ChunkTable:
    """LATERAL chunk_md(text, source): a row for each chunk."""

    def eval(self, text: str | None, source: str | None):
        for c in chunks(text or "", source or ""):
            row = _row(c)
            yield tuple(row[f.name] for f in CHUNK.fields)


def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(x @ y / ((x @ x) ** 0.5 * (y @ y) ** 0.5 or 1.0)) for x, y in zip(a, b, strict=True)])


def register(spark: SparkSession) -> None:
    """html_to_md, page_links, compact, chunks, cosine, and the table function chunk_md."""
    spark.udf.register("html_to_md", F.pandas_udf(_markdown, T.StringType()))
    spark.udf.register("page_links", F.pandas_udf(_links, T.ArrayType(T.StringType())))
    spark.udf.register("compact", F.pandas_udf(_compact, T.StringType()))
    spark.udf.register("chunks", F.pandas_udf(_chunks, T.ArrayType(CHUNK)))
    spark.udf.register("cosine", F.pandas_udf(cosine, T.DoubleType()))
    spark.udtf.register("chunk_md", F.udtf(ChunkTable, returnType=CHUNK))
