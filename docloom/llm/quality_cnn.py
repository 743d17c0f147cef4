"""Quality classifier: a byte-level convolutional network in numpy.

Filters of `WIDTH` bytes move over the whole text in steps of `STEP`. Over one-hot bytes a filter is one row of a table
for each offset, so the convolution is a sum of table rows. Its rectified outputs are max-pooled over chunks of `CHUNK`
bytes that overlap by half and cover the whole document; the chunks' features are averaged and a linear layer gives one
probability. Filters and layer are learned together by gradient descent (Adam) through the pooling.

Training takes a bounded sample: about `rows` labelled documents chosen by a hash of the id, fewer where these have
more than `most` bytes together, and all chunks of each. So its cost doesn't depend on the corpus. Scoring reads every
byte.

Nulls and edges: null and empty texts are one chunk of zero bytes; rows with a null label or id aren't learned from; a
document labelled more than once counts with its highest label; repeated rows get equal scores; without training rows
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, text_bytes

WIDTH, STEP, CHUNK, FILTERS = 6, 2, 256, 16
PER = CHUNK // STEP  # filter positions in a chunk
BLOCK = 1 << 16


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"w": (r.normal(size=(WIDTH, 256, FILTERS)) * 0.15).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "v": (r.normal(size=FILTERS) * 0.3).astype(np.float32), "c": np.zeros(1, np.float32)}

    def conv(self, data: np.ndarray) -> np.ndarray:
        """Filter outputs at every STEP-th byte of data, which is followed by WIDTH bytes more."""
        w = self.p["w"]
        n = (len(data) - WIDTH) // STEP
        out = w[0].take(data[: n * STEP : STEP], axis=0)
        for j in range(1, WIDTH):
            out += w[j].take(data[j : j + n * STEP : STEP], axis=0)
        return out

    def features(self, text: np.ndarray) -> np.ndarray:
        """The mean over the text's chunks of what the filters find in each."""
        halves = max(2, -(-len(text) // (CHUNK // 2)))
        padded = np.zeros(halves * (CHUNK // 2) + WIDTH, np.uint8)
        padded[: len(text)] = text
        pooled = np.concatenate([self.conv(padded[a : min(a + BLOCK, halves * (CHUNK // 2)) + WIDTH]).reshape(-1, PER // 2, FILTERS).max(1) for a in range(0, halves * (CHUNK // 2), BLOCK)])
        return np.maximum(np.maximum(pooled[1:], pooled[:-1]) + self.p["b"], 0).mean(0)

    def score(self, text: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.p["v"] + self.p["c"][0], -30, 30))))

    def fit(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
        """Both classes weigh alike, however rare one is. chunks: (n, CHUNK + WIDTH) bytes; doc: the document of each, from 0 and in order; label: by document."""
        r, first = np.random.default_rng(seed), np.searchsorted(doc, np.arange(len(label) + 1))
        weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label <= 0).sum())) * len(label)
        moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            for docs in np.array_split(r.permutation(len(label)), max(1, len(label) // 64)):
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                inside = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                x, of = chunks[rows], (first[docs + 1] - first[docs])[inside]
                z = sum(self.p["w"][j].take(x[:, j : j + CHUNK : STEP], axis=0) for j in range(WIDTH))
                at = z.argmax(1)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"]
                feature = np.zeros((len(docs), FILTERS), np.float32)
                np.add.at(feature, inside, np.maximum(top, 0) / of[:, None])
                prob = 1 / (1 + np.exp(-np.clip(feature @ self.p["v"] + self.p["c"], -30, 30)))
                err = (weight[docs] * (prob - label[docs]) / len(docs)).astype(np.float32)
                g = err[inside][:, None] * self.p["v"] * (top > 0) / of[:, None]
                gw = np.zeros_like(self.p["w"])
                for j in range(WIDTH):
                    byte = x[np.arange(len(x))[:, None], at * STEP + j]
                    np.add.at(gw[j], (byte, np.arange(FILTERS)), g)
                grads = {"w": gw, "b": g.sum(0), "v": feature.T @ err, "c": err.sum(keepdims=True)}
                step += 1
                for k, p in self.p.items():
                    m, s = moments[k]
                    d = grads[k] + 1e-5 * p
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def _chunks(text: np.ndarray) -> np.ndarray:
    """All chunks of a text, as scoring sees them, each with the WIDTH bytes that follow."""
    halves = max(2, -(-len(text) // (CHUNK // 2)))
    padded = np.zeros(halves * (CHUNK // 2) + WIDTH, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH)[:: CHUNK // 2]


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 1500, most: int = 32 << 20) -> Network:
    """Learn label_col of labels from about `rows` of the rows of labels for which train (of the id) holds."""
    bounded(docs.sparkSession)
    known = labels.filter(train).groupBy(id_col).agg(F.max(label_col).alias("__label")).filter("__label is not null")
    n = known.count()
    h = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(4)), F.lit(1 << 20)) / float(1 << 20)

    def sample(share: float) -> DataFrame:
        some = known.filter(h < share).withColumnRenamed(id_col, "__id")  # about `rows` rows
        found = docs.join(F.broadcast(some), F.col(id_col) == F.col("__id"))
        return found.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col("__label").cast("int").alias("l"))

    share = rows / max(1, n)
    found = sample(share)
    size = found.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = found if size <= most else sample(share * most / size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_bytes(b.column("t"))
            got = [_chunks(data[a:z]).tobytes() for a, z in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("i").cast(pa.string()), b.column("l"), pa.array(got, pa.binary())], ["i", "l", "x"])

    sample = sorted((r["i"] or "", r["l"], bytes(r["x"])) for r in found.mapInArrow(cut, "i string, l int, x binary").collect())  # bounded by rows and most
    net = Network()
    if not sample:
        net.p = {k: x * 0 for k, x in net.p.items()}
        return net
    x = [np.frombuffer(b, np.uint8).reshape(-1, CHUNK + WIDTH) for _, _, b in sample]
    return net.fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(b) for b in x]), np.array([v > 0 for _, v, _ in sample], np.float32))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of each whole text."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            offsets, data = text_bytes(b.column("t"))
            got = [net.score(data[a:z]) for a, z in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(got, pa.float64())], ["i", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, score double").withColumnRenamed("i", id_col)
