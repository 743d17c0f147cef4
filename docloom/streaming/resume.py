"""Incremental embedding: new chunk shards since the last run, each embedded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def embed_new(spark: SparkSession, shards: str, schema: T.StructType, out: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]) -> None:
    """Read the JSON shards that the checkpoint hasn't seen, drop repeated ids of this run, embed and append.

    A file stream with availableNow: it ends when all there is has been read, and its checkpoint makes a rerun after a
    loss exact.
    """

    def write(rows: DataFrame, batch: int) -> None:
        new = rows.dropDuplicates(["id"])
        try:
            new = new.join(spark.read.parquet(out).select("id"), "id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        embed(new).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).json(shards)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
