"""Removal of byte strings of a given length that start in more than one place, by sorting sampled suffixes.

Every string of `length` bytes has a content-defined anchor: its smallest GRAM-byte hash. Equal strings have it at the
same offset, so only suffixes that begin at anchors (or a multiple of STEP before one) need be sorted, about two for
every 200 bytes; each stands for the strings that cover its leading `length - STEP + 1` bytes and differ by where they
begin. Then:

1. Suffixes are counted by a hash of their leading bytes and of everything they stand for. Most are settled by this:
   leading bytes that occur once repeat nowhere, and suffixes whose whole context occurs twice are repeated as a whole.
2. The rest, next to the edges of repeated passages, are range-partitioned by their leading bytes (Spark samples the
   splitters) and sorted in their bucket by multikey quicksort, once by what follows the leading bytes and once by what
   precedes them. Neighbours are compared to give common lengths, also across the batches of a bucket; equal leading
   bytes never lie in two buckets. A string repeats if another suffix shares enough on both sides.
3. Leading bytes shared by more than `BLOCK` different suffixes don't go to one task: their strings are hashed one by
   one and counted with a partial sum.

`remove` also tells the longest passage of a text that another document has as well. Passages are found by marks: the
`MARK` bytes around each content-defined anchor of `MARK_WINDOW` bytes, about one for every 70 bytes, hashed and counted
by document; neighbouring marks that are found elsewhere are one run. This sees passages too short for `length`: every
one of MARK + MARK_WINDOW bytes or more has a mark, and its run ends less than MARK_WINDOW bytes short at either end.

With `words`, passages of so many words or more that another document has go, too, however few bytes they have. As with
bytes, each window of so many words has a content-defined anchor, its smallest hash of WORD_GRAM words;
only windows whose anchor occurs again are hashed as a whole, and those whose hash more than one document has go. Words
stand between ASCII white space, which itself isn't compared.

Copies of a text in a batch are read once and count as many times; texts are known by two 64-bit hashes, so copies of a
text share one list of spans.

Nulls and edges: null text is empty; texts shorter than `length` lose nothing; repeated rows are copies of each other
and so lose what copies lose; ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, pieces, release, text_bytes, tidy

GRAM, PARTS, BLOCK, BROADCAST_ENTRIES, KEPT = 16, 3, 5_000, 500_000, 4 << 20
MARK, MARK_WINDOW = 120, 160
WORD_GRAM, PASSAGE_WORDS = 16, 51
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_R = np.random.default_rng(19920229)
CODE = _R.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of data in constant time each; with code None, data are hashes of the elements already."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, code: np.ndarray | None = CODE):
        n = len(data) + 1
        if len(Rolling.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n * 5 // 4, np.uint64(b))])) for b in (BASE, INVERSE))
            if n < KEPT:  # the powers for a very long text go with it
                Rolling.up, Rolling.down = self.up, self.down
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data if code is None else code[data]) * self.up[: n - 1])])

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[begin + size] - self.sums[begin]) * self.down[begin])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchors(rolling: Rolling, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of each string of `length` bytes (or words) that lies within a text."""
    sizes = np.diff(offsets)
    start = np.concatenate([np.arange(a, a + n - length + 1) for a, n in zip(offsets, sizes, strict=False) if n >= length] or [np.zeros(0, np.int64)])
    if not len(start):
        return start, start
    window = length - gram + 1
    value = (rolling.grams(gram) & np.uint64(~((1 << 28) - 1) & (1 << 64) - 1)) | np.arange(len(rolling.sums) - gram, dtype=np.uint64)
    blocks = -(-len(value) // window)
    padded = np.full(blocks * window, np.uint64((1 << 64) - 1))
    padded[: len(value)] = value
    table = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return start, (np.minimum(behind[start], ahead[start + window - 1]) & np.uint64((1 << 28) - 1)).astype(np.int64)


def suffixes(offsets: np.ndarray, data: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """text: its number; s: place in the text; low, high: how far before s the strings begin; core, context: hashes."""
    step = -(-(length - GRAM + 1) // PARTS)
    rolling = Rolling(data)
    start, anchor = anchors(rolling, offsets, length)
    back = anchor - start
    part = back // step
    s = anchor - part * step
    new = np.ones(len(start), bool)
    text = np.searchsorted(offsets, start, side="right") - 1
    new[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    s, part, text = s[first], part[first], text[first]
    high, low = s - start[first], s - start[last]
    salt = part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    core = mix(rolling.of(s, length - step + 1) + salt)
    begin = s - high
    context = mix(rolling.of(begin, high - low + length) + salt + (high * 1024 + low).astype(np.uint64) * np.uint64(BASE))
    return {"text": text, "s": s - offsets[text], "low": low, "high": high, "core": core.astype(np.int64), "context": context.astype(np.int64)}


def multikey_sort(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of rows by group and then by their words: partition by one word, go on to the next where words tie."""
    order = np.argsort(group, kind="stable")
    bounds = group[order]
    tie = np.ones(len(order), bool)
    for depth in range(words.shape[1]):
        tie[:] = False
        same = bounds[1:] == bounds[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        at = np.flatnonzero(tie)
        if not len(at):
            break
        w = words[order[at], depth]
        by = np.lexsort((w, bounds[at]))
        order[at] = order[at][by]
        w = w[by]
        new = np.ones(len(at), bool)
        new[1:] = (w[1:] != w[:-1]) | (bounds[at][1:] != bounds[at][:-1])
        fresh = bounds.copy()
        fresh[at] = np.cumsum(new) + (depth + 1) * (len(order) + 1) + int(bounds.max()) + 1
        # Numbers only need differ between groups; rows outside ties are alone already.
        bounds = np.unique(fresh, return_inverse=True)[1] if depth % 8 == 7 else fresh
    return order


def shared(order: np.ndarray, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bytes that each sorted row has in common with the one before it; -1 in front of a group."""
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return np.concatenate([[-1], common])


def repeated(group: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(row, j) true where the string that begins j bytes before row's suffix begins at another row of the group too.

    before: the bytes before the suffix, nearest first; after: those behind its leading bytes; both STEP - 1 wide.
    """
    n, width = before.shape
    pad = -width % 8
    sides = []
    for rows in (before, after):
        words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")
        order = multikey_sort(group, words)
        sides.append((order, shared(order, group, rows)))
    out = np.zeros((n, width + 1), bool)
    for j in range(width + 1):
        ids = []
        for (order, common), need in zip(sides, (j, width - j), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(common < need)
            ids.append(number)
        may = np.flatnonzero((low <= j) & (j <= high))
        both = ids[0][may] * (n + 1) + ids[1][may]
        _, of, count = np.unique(both, return_inverse=True, return_counts=True)
        out[may, j] = count[of] > 1
    return out


def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [begin, end)."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


@tidy
def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, spans of rows(x, y, r): the maximal runs of r, which has start << 32 | end."""
    for b in batches:
        out = []
        for r in b.column("r").to_pylist():
            v = np.array(r, np.int64)
            a, z = spans(v >> 32, v & 0xFFFFFFFF)
            out.append((a << 32 | z).tolist())
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(out, pa.list_(pa.int64()))], ["x", "y", "spans"])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(t.alias("t"), F.xxhash64(t, F.lit(1)).alias("x"), F.xxhash64(t, F.lit(2)).alias("y"))


def _sent(rows: DataFrame, lists: str) -> DataFrame:
    """rows, to every executor if their lists have few entries in all; else the join shuffles."""
    entries = rows.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    return F.broadcast(rows) if entries <= BROADCAST_ENTRIES else rows


def once(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """x, y of each different text of a batch, how many copies it has there, and where the first is."""
    count: dict[tuple[int, int], int] = {}
    first: list[int] = []
    for i, xy in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
        if xy not in count:
            first.append(i)
        count[xy] = count.get(xy, 0) + 1
    x, y = (np.array(c, np.int64) for c in zip(*count, strict=True))
    return x, y, np.array(list(count.values()), np.int64), first


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """x, y (the hashes of _texts), spans: the runs of repeated bytes of each text that has any, as start << 32 | end."""
    step = -(-(length - GRAM + 1) // PARTS)
    lead = length - step + 1
    spark = docs.sparkSession
    bounded(spark)

    @tidy
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 19):
            x, y, copies, first = once(b)
            got = suffixes(*text_bytes(b.column("t").take(pa.array(first))), length)
            of = got["text"]
            place = got["s"] << 20 | got["low"] << 10 | got["high"]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[of], y[of], copies[of], place, got["core"], got["context"])], ["x", "y", "n", "place", "core", "context"])

    found = materialise(_texts(docs, text_col).mapInArrow(sample, "x long, y long, n long, place long, core long, context long"), "suffixes")
    # Partial sums first: a passage in very many texts is one row a task here.
    seen = found.groupBy("core", "context").agg(F.sum("n").alias("n"), F.min(F.struct("x", "y", "place")).alias("one"))
    cores = seen.groupBy("core").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.max("n").alias("most")).filter("all > 1")
    repeats = materialise(seen.join(cores, "core"), "suffix-repeats")
    whole = found.join(repeats.filter("n > 1").select("core", "context"), ["core", "context"]).select("x", "y", "place")
    whole = whole.select("x", "y", F.shiftright("place", 20).alias("s"), F.shiftright("place", 10).bitwiseAND(1023).alias("low"), F.col("place").bitwiseAND(1023).alias("high"))
    whole = whole.select("x", "y", (F.col("s") - F.col("high")).alias("begin"), (F.col("s") - F.col("low") + length).alias("end"))

    # One suffix for each different context of cores that have several: those settled are there to be compared with.
    rest = repeats.filter("kinds > 1").select("one.x", "one.y", F.struct(F.col("one.place").alias("place"), "core", (F.col("kinds") > BLOCK).alias("big"), F.col("n")).alias("r"))
    rest = materialise(rest.groupBy("x", "y").agg(F.collect_list("r").alias("r")), "suffix-rest")
    rest = rest.withColumnsRenamed({"x": "__x", "y": "__y"})
    some = _sent(rest, "r")
    joined = _texts(docs, text_col).join(some, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))).select("x", "y", "t", "r")
    kind = "x long, y long, place long, n long, big boolean, core long, lead long, before binary, after binary"

    @tidy
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 19):
            out: list[list] = [[] for _ in range(9)]
            done = set()
            for x, y, t, r in zip(*(b.column(c).to_pylist() for c in ("x", "y", "t", "r")), strict=True):
                if (x, y) in done:
                    continue
                done.add((x, y))
                raw = t.encode()
                for e in r:
                    s = e["place"] >> 20
                    before, after = raw[max(0, s - step + 1) : s][::-1], raw[s + lead : s + lead + step - 1]
                    for column, v in zip(out, (x, y, e["place"], e["n"], e["big"], e["core"], int.from_bytes(raw[s : s + 8], "big") >> 1, before.ljust(step - 1, b"\0"), after.ljust(step - 1, b"\0")), strict=True):
                        column.append(v)
            if out[0]:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], [f.split()[0] for f in kind.split(", ")])

    near = joined.mapInArrow(contexts, kind).dropDuplicates(["x", "y", "place"])

    def ranges(x: np.ndarray, y: np.ndarray, place: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        """Rows for each run of begins that repeat."""
        wide = np.pad(hit, ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(wide, axis=1)
        row, j0 = np.nonzero(change == 1)
        _, j1 = np.nonzero(change == -1)
        s = place[row] >> 20
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (x[row], y[row], s - (j1 - 1), s - j0 + length)], ["x", "y", "begin", "end"])

    @tidy
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            x, y, place, core = (t.column(c).to_numpy() for c in ("x", "y", "place", "core"))
            before, after = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, step - 1) for c in ("before", "after"))
            group = np.unique(core, return_inverse=True)[1]
            return ranges(x, y, place, repeated(group, before, after, place >> 10 & 1023, place & 1023))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            held = t
            if t.num_rows >= 20_000:
                core = t.column("core").to_numpy()
                cut = np.flatnonzero(np.diff(core))
                if len(cut):
                    yield work(t.slice(0, int(cut[-1]) + 1))
                    held = t.slice(int(cut[-1]) + 1)
        if held is not None and held.num_rows:
            yield work(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = near.filter(~F.col("big")).repartitionByRange(parts, "lead", "core").sortWithinPartitions("lead", "core")
    edges = bucket.mapInArrow(sort, "x long, y long, begin long, end long")

    @tidy
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash for each string of a suffix whose leading bytes are too common."""
        for b in batches:
            if not b.num_rows:
                continue
            before, after = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, step - 1) for c in ("before", "after"))
            place, core = b.column("place").to_numpy(), b.column("core").to_numpy().astype(np.uint64)
            low, high = place >> 10 & 1023, place & 1023
            row = np.repeat(np.arange(len(place)), high - low + 1)
            j = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            left = np.cumsum(np.pad(CODE[before], ((0, 0), (1, 0))) * powers(step), 1)
            right = np.cumsum(np.pad(CODE[after], ((0, 0), (1, 0))) * powers(step), 1)
            h = mix(mix(left[row, j] + core[row]) + right[row, step - 1 - j] * np.uint64(3) + j.astype(np.uint64) * np.uint64(BASE))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (b.column("x").to_numpy()[row], b.column("y").to_numpy()[row], (place >> 20)[row] - j, h.astype(np.int64))], ["x", "y", "begin", "h"])

    strings = near.filter("big").mapInArrow(each, "x long, y long, begin long, h long")
    common = strings.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    edges = edges.unionByName(strings.join(common, "h").select("x", "y", "begin", (F.col("begin") + length).alias("end")))

    both = whole.unionByName(edges).select("x", "y", (F.shiftleft("begin", 32).bitwiseOR(F.col("end"))).alias("r"))
    return both.groupBy("x", "y").agg(F.collect_set("r").alias("r")).mapInArrow(merge, "x long, y long, spans array<long>")


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(begin and end of each word, first word of each text and the end, hashes of any runs of words)."""
    solid = ~SPACE[data]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    start[first], stop[last] = solid[first], solid[last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(begin, offsets), Rolling(Rolling(data).of(begin, end - begin), None)


def repeated_passages(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """x, y, spans as of repeated_spans(), written: the runs of `words` words or more that another document has too."""
    if not WORD_GRAM <= words < 1024:
        raise ValueError(f"passages have {WORD_GRAM} to 1023 words")
    spark = docs.sparkSession
    bounded(spark)

    @tidy
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each anchor, as number of the first in its text << 10 | how many."""
        for b in pieces(batches, "t", 1 << 19):
            x, y, copies, own = once(b)
            _, _, first, rolling = words_of(*text_bytes(b.column("t").take(pa.array(own))))
            start, anchor = anchors(rolling, first, words, WORD_GRAM)
            text = np.searchsorted(first, start, side="right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(start)))
            of = text[at]
            core = rolling.of(anchor[at], WORD_GRAM).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[of], y[of], copies[of], (start[at] - first[of]) << 10 | many, core)], ["x", "y", "n", "place", "core"])

    found = materialise(_texts(docs, text_col).mapInArrow(sample, "x long, y long, n long, place long, core long"), "suffix-anchors")
    again = found.groupBy(F.col("core").alias("__core")).agg(F.sum("n").alias("n")).filter("n > 1").select("__core")
    rest = found.join(again, F.col("core") == F.col("__core")).groupBy(F.col("x").alias("__x"), F.col("y").alias("__y")).agg(F.collect_set("place").alias("r"))
    rest = materialise(rest, "suffix-anchors-again")
    joined = _texts(docs, text_col).join(_sent(rest, "r"), (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))).select("x", "y", "t", "r")

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash of each window; n: the documents that its text stands for, once for each hash of a text."""
        for b in pieces(batches, "t", 1 << 19):
            x, y, copies, own = once(b)
            b = b.take(pa.array(own))
            offsets, data = text_bytes(b.column("t"))
            begin, end, first, rolling = words_of(offsets, data)
            lists = b.column("r")
            place = lists.flatten().to_numpy()
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            many = place & 1023
            row = np.repeat(np.arange(len(place)), many)
            text = text[row]
            start = first[text] + (place[row] >> 10) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            h = rolling.of(start, words)
            order = np.lexsort((h, text))
            fresh = np.ones(len(row), bool)
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
            n = np.zeros(len(row), np.int64)
            n[order[fresh]] = copies[text[order[fresh]]]
            span = (begin[start] - offsets[text]) << 32 | (end[start + words - 1] - offsets[text])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[text], y[text], n, span, h.astype(np.int64))], ["x", "y", "n", "r", "h"])

    whole = materialise(joined.mapInArrow(windows, "x long, y long, n long, r long, h long"), "suffix-windows")
    common = whole.groupBy(F.col("h").alias("__h")).agg(F.sum("n").alias("n")).filter("n > 1").select("__h")
    hit = whole.join(common, F.col("h") == F.col("__h")).groupBy("x", "y").agg(F.collect_set("r").alias("r"))
    out = materialise(hit.mapInArrow(merge, "x long, y long, spans array<long>"), "suffix-passages")
    discard(spark, found, rest, whole)
    return out


def marks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of the MARK bytes around each anchor that has as many; each hash once a text."""
    rolling = Rolling(data)
    _, anchor = anchors(rolling, offsets, MARK_WINDOW)
    at = np.unique(anchor) - MARK // 2
    text = np.searchsorted(offsets, at + MARK // 2, side="right") - 1
    inside = (at >= offsets[text]) & (at + MARK <= offsets[text + 1])
    at, text = at[inside], text[inside]
    h = rolling.of(at, MARK)
    _, once = np.unique(np.stack([text.astype(np.uint64), h]), axis=1, return_index=True)
    return text[once], (at - offsets[text])[once], h[once].astype(np.int64)


def passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """x, y (the hashes of _texts), shared: the longest run of bytes that another document has too."""
    spark = docs.sparkSession
    bounded(spark)

    @tidy
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 19):
            x, y, copies, first = once(b)
            text, place, h = marks(*text_bytes(b.column("t").take(pa.array(first))))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[text], y[text], copies[text], place, h)], ["x", "y", "n", "place", "h"])

    found = materialise(_texts(docs, text_col).mapInArrow(sample, "x long, y long, n long, place long, h long"), "suffix-marks")
    again = found.groupBy(F.col("h").alias("__h")).agg(F.sum("n").alias("n")).filter("n > 1").select("__h")
    again = materialise(again, "suffix-marks-again")
    hit = found.join(again, F.col("h") == F.col("__h")).select("x", "y", F.shiftleft("place", 32).bitwiseOR(F.col("place") + MARK).alias("r"))

    @tidy
    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column("r").to_pylist():
                v = np.array(r, np.int64)
                a, z = spans(v >> 32, v & 0xFFFFFFFF)
                out.append(int((z - a).max()))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(out, pa.int64())], ["x", "y", "shared"])

    runs = hit.groupBy("x", "y").agg(F.collect_set("r").alias("r")).mapInArrow(longest, "x long, y long, shared long")
    out = materialise(runs, "suffix-passages")
    discard(spark, found, again)
    return out


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, np.uint64(BASE)))


def with_spans(docs: DataFrame, text_col: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """docs with __spans, null where nothing repeats: strings of `length` bytes and, unless None, passages of `words` words."""
    also = repeated_passages(docs, text_col, words) if words else None
    found = repeated_spans(docs, text_col, length)
    if also is not None:
        found = found.unionByName(also).groupBy("x", "y").agg(F.flatten(F.collect_list("spans")).alias("r")).mapInArrow(merge, "x long, y long, spans array<long>")
    found = materialise(found, "suffix-spans").withColumnsRenamed({"x": "__x", "y": "__y", "spans": "__spans"})
    found = _sent(found, "__spans")
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(found, (F.xxhash64(t, F.lit(1)) == F.col("__x")) & (F.xxhash64(t, F.lit(2)) == F.col("__y")), "left").drop("__x", "__y")


def kept_of(raw: bytes, runs: list[int] | None) -> tuple[bytes, int]:
    """What is left of a text, and how many bytes go."""
    if not runs:
        return raw, 0
    out, at, gone = [], 0, 0
    for r in runs:
        a, z = r >> 32, r & 0xFFFFFFFF
        out.append(raw[at:a])
        gone += z - a
        at = z
    return b"".join([*out, raw[at:]]), gone


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int | None = None, words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, longest_shared (see passages(), 0 for none) of each text.

    See without_repeats() for length and words; with neither, strings of 400 bytes and passages of 51 words go.
    """
    length, words = (length or 400, words) if length or words else (400, PASSAGE_WORDS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            rows = []
            for t, s in zip(b.column("t").to_pylist(), b.column("s").to_pylist(), strict=True):
                raw = (t or "").encode()
                kept, gone = kept_of(raw, s)
                rows.append((len(raw), gone, len(s or ()), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("i"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)), b.column("p")], ["i", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "longest_shared"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    shared_ = passages(rows, "t").withColumnsRenamed({"x": "__x", "y": "__y"})
    release(docs.sparkSession)
    shared_ = F.broadcast(shared_) if shared_.count() <= BROADCAST_ENTRIES else shared_
    t = F.coalesce(F.col("t"), F.lit(""))
    out = with_spans(rows, "t", length, words).join(shared_, (F.xxhash64(t, F.lit(1)) == F.col("__x")) & (F.xxhash64(t, F.lit(2)) == F.col("__y")), "left")
    out = out.select("i", "t", F.col("__spans").alias("s"), F.coalesce("shared", F.lit(0).cast("long")).alias("p"))
    return out.mapInArrow(run, f"i {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, longest_shared long").withColumnRenamed("i", id_col)


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", length: int = 400, words: int | None = None) -> DataFrame:
    """docs with what is left of each text (characters of which a byte goes, go) and, in chars_col, its code points.

    Strings of `length` bytes that start in more than one place go, and with `words`, passages of so many words or more
    that another document has.
    """
    marked = with_spans(docs, text_col, length, words)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            texts = [t if not s else kept_of(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(b.column(text_col).to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            columns.pop("__spans")
            columns[text_col] = pa.array(texts, pa.string())
            if chars_col in columns:
                columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return marked.mapInArrow(run, docs.schema)
