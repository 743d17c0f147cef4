"""Exact top-k by inner product with a vector-approximation file.

Each component is quantised to one of 2^BITS cells, one byte, between the block's smallest and largest component. For a
query the cells give an upper and a lower bound of every score; the scan of cells is one product in single precision,
and the bounds are widened by what its rounding can add up to. Vectors whose upper bound is below the k-th largest lower
bound are left out by that scan alone; the others' exact integer vectors are read in order of their upper bounds, until
the k-th best exact score is at least the next bound.

Data rows are scanned where they are, once for each batch of `BATCH` queries; a task returns k rows a query at most, and
the k best of all tasks are picked by query. Queries are written with a number of their own and read in batches of
bounded size, so what is sent to the executors doesn't grow with the table, nor does the plan: each batch's results are
appended to one table.

Nulls and edges: vectors that are null, empty, or hold null or non-finite components take no part, as queries or as
candidates; null ids take no part either; a query's candidates are the vectors of its own dimension whose id is another
one; each query row gets ranks of its own, also where ids repeat; equal rows are candidates each; ties go to the smaller
id; fewer candidates than k give fewer rows; without queries the result is empty; scores are exact up to 2^63.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, materialise, shared_folder

BITS, BATCH = 6, 20_000
OUT = "q long, query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("i"), F.transform(v, lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("v"))


class Approximation:
    """The cells of some integer vectors, and bounds of their inner products with a query."""

    def __init__(self, vectors: np.ndarray):
        self.low = float(vectors.min())
        self.width = max(1.0, (float(vectors.max()) - self.low) / ((1 << BITS) - 1e-6))
        self.cells = np.clip((vectors - self.low) // self.width, 0, (1 << BITS) - 1).astype(np.uint8)
        self.wide = self.cells.astype(np.float32)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) by query and vector."""
        q = queries.astype(np.float64)
        at = (q * self.width).astype(np.float32) @ self.wide.T
        whole, size = q.sum(1, keepdims=True), np.abs(q).sum(1, keepdims=True)
        # What rounding adds to a sum of products is below its terms' sizes times their number times the last bit's.
        slack = size * (self.width * (1 << BITS) + abs(self.low)) * (queries.shape[1] + 8) * 2.0**-23
        # A vector lies at most a width above its cell's lower corner in each component.
        up, down = np.maximum(q, 0).sum(1, keepdims=True) * self.width, np.minimum(q, 0).sum(1, keepdims=True) * self.width
        return at + (self.low * whole + down - slack), at + (self.low * whole + up + slack)


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, by its place; vector id; score) of each query's k best vectors of another id in this block."""
    file = Approximation(vectors)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(queries), 256):
        q, qid = queries[begin : begin + 256], query_ids[begin : begin + 256]
        lower, upper = file.bounds(q)
        own = qid[:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        sure = np.partition(lower, -k, 1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
        for r in range(len(q)):
            may = np.flatnonzero((upper[r] >= sure[r]) & (upper[r] > -np.inf))
            may = may[np.argsort(-upper[r, may], kind="stable")]
            best, found, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            while at < len(may) and (len(best) < k or upper[r, may[at]] >= best[k - 1]):
                part = may[at : at + 64]  # exact vectors, in order of their bounds
                best, found = np.concatenate([best, vectors[part] @ q[r]]), np.concatenate([found, ids[part]])
                order = np.lexsort((found, -best))[:k]
                best, found = best[order], found[order]
                at += 64
            got.append((np.full(len(best), begin + r), found, best))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def by_width(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the lists of each length."""
    sizes = np.diff(lists.offsets.to_numpy())
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), int(width))


def search(vectors: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner products for each row where `query` holds."""
    spark = vectors.sparkSession
    bounded(spark)
    rows = usable(vectors, id_col, vector_col)
    asked = materialise(usable(vectors.filter(query), id_col, vector_col).withColumn("q", F.monotonically_increasing_id()), "va-queries")

    def scan(batch: pa.Table) -> DataFrame:
        lists = batch.column("v").combine_chunks()
        numbers, ids = batch.column("q").to_numpy(), batch.column("i").to_numpy()
        queries = {table.shape[1]: (numbers[at], ids[at], table) for at, table in by_width(lists)}
        sent = spark.sparkContext.broadcast(queries)  # BATCH queries at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column("i").to_numpy()
                for at, table in by_width(b.column("v")):
                    if table.shape[1] not in sent.value:
                        continue
                    number, qid, q = sent.value[table.shape[1]]
                    for a in range(0, len(at), block):
                        place, found, score = best_of(own[at[a : a + block]], table[a : a + block], qid, q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[place], qid[place], found, score)], ["q", "query_id", "vec_id", "score"])

        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = rows.mapInArrow(run, OUT).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
        return best.select("query_id", "rank", "vec_id", "score")

    after, path, one = -1, f"{shared_folder(spark)}/docloom-va-{uuid.uuid4().hex}", None
    while True:
        batch = asked.filter(F.col("q") > after).orderBy("q").limit(BATCH).toArrow()
        if batch.num_rows < BATCH and after < 0:  # one batch has them all
            return scan(batch) if batch.num_rows else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        if batch.num_rows:
            one = scan(batch)
            one.write.mode("append").parquet(path)
            after = int(batch.column("q")[-1].as_py())
        if batch.num_rows < BATCH:
            return spark.read.schema(one.schema).parquet(path)
