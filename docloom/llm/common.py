"""What the operators of this subpackage share: tables, the shared scratch folder and column conventions."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space, as the contracts of several operators define them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
BYTE_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session within one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _file(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: What materialise() has written and nobody has discarded yet, in order.
WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives the loss of any executor.

    What is written goes when it is discarded, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file(spark, path)
    files.deleteOnExit(at)
    WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(spark: SparkSession, *written: DataFrame, since: int | None = None, keep: DataFrame | None = None) -> None:
    """Delete these results of materialise(), or all since WRITTEN had `since` entries but `keep`. No plan may read them any more."""
    paths = [getattr(df, "_written", None) for df in written] + (WRITTEN[since:] if since is not None else [])
    for path in paths:
        if path in WRITTEN and path != getattr(keep, "_written", None):
            files, at = _file(spark, path)
            files.delete(at, True)
            WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more, instead of when the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def crc_mod(column: str, mod: int) -> Column:
    """crc32(column as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def crc_of(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z only; other letters keep their case. Null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def give_back() -> None:
    """Return a worker's free memory to the system at the end of a task: Spark keeps workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and give_back() when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Batches between Spark and Python of 4 MB, not of 10,000 rows of any length, unless the session says otherwise."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, "4m")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes each, so that a worker's memory doesn't follow the batch size.

    `column` has the texts; the other columns' bytes count as spread evenly over the rows.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets, data = text_bytes(batch.column(column))
        offsets = offsets + np.arange(n + 1) * max(0, batch.nbytes - len(data)) // n
        begin = 0
        while begin < n:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="left"))
            end = min(n, max(begin + 1, end))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without a copy for each row; null is empty. offsets[0] is 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
