"""Exact Jaccard self-join of word n-gram sets by prefix trees, giving connected components.

1. A document's n-grams (64-bit hashes) give its size, its prefix (the first elements in one global order, of which two
   sets that link must share one) and a parity bitmap: the Hamming distance of two bitmaps is never more than the number
   of n-grams in which the sets differ. The order puts n-grams that are frequent in a sample of the documents last, most
   frequent at the very end, the others by hash. Any order gives the same links; this one keeps common passages out of
   prefixes.
2. Equal sets are found by a 128-bit hash with a partial minimum; one row stands for them in all that follows.
3. Rows that share a prefix element and whose sizes and bitmaps allow a link are joined into candidate clusters. In a
   group of sharers a breadth-first walk over bitmaps emits a forest, not all pairs. Most elements belong to one row, or
   to rows joined already: one sum by element finds the others, and a filter of those, sent to every executor, keeps the
   rest of the prefixes from being shuffled once more. Beyond a number of elements both go by parts of the elements, so that
   the files of one part's shuffle are all that is on disk at once.
4. Each cluster's sets are stored in a trie, most frequent n-gram first, with runs of n-grams on one edge. A set is
   compared with all others at once: overlaps along shared paths are counted once, and a subtree ends as soon as what
   remains of it and of the set can't reach the overlap needed. Linked documents leave the trie, so a cluster of near
   copies costs about one traversal.

Groups and clusters beyond `BLOCK` rows or `ELEMENTS` n-grams are dealt in two passes. In the first each block meets a
few hubs of its group, which joins near copies at a cost in proportion to the group. In the second only groups that
still hold rows not joined take part: their rows outside the largest joined part meet each other and that part, block
by block. No task holds more than two blocks, and edges are never collected.

Nulls and edges: null and blank texts have an empty set and are their own component; a text of fewer than n words is
one n-gram; rows are told apart by their place in the table, so ids may repeat; a null id counts as no id: its row gets
the smallest id linked to it, null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE_LOWER, WRITTEN, bounded, discard, materialise, pieces, release, text_bytes, tidy
from .components import components

BLOCK, ELEMENTS, HUBS, BROADCAST_ROWS, FIRST = 5_000, 2_000_000, 16, 500_000, 2
#: Prefix elements, and rows of shared ones, that are shuffled at once: beyond that, by parts of the elements, one after another.
TOKENS, SHARED = 32_000_000, 6_000_000
#: One in SAMPLE documents shows which n-grams are frequent: in LEAST of them or more, however many there are, so that groups
#: of sharers don't grow with the table; HOT at most. Only the order depends on it.
SAMPLE, LEAST, HOT = 32, 3, 200_000
#: A filter of elements has FILTER_BITS bits or more for each, in FILTER_PARTS parts, but MOST_BITS (32 MB) at most.
FILTER_BITS, MOST_BITS, FILTER_PARTS = 16, 1 << 28, 64
_R = np.random.default_rng(20240229)
LOWER = np.frombuffer(BYTE_LOWER, np.uint8)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
CODE = np.where(SPACE, 0, _R.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15)
SALT = _R.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end)."""
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] |= solid[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(start)
    inside = np.arange(len(data)) - at[np.maximum(number - 1, 0)]
    inside[~solid] = 0
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(inside.max()), BASE)]))
    hashes = mix(np.add.reduceat(CODE[data] * power[inside], at))
    return hashes, np.concatenate([[0], number])[offsets]


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    offsets, data = text_bytes(column)
    words, first = word_hashes(offsets, data)
    whole = np.zeros(0, np.uint64)
    if len(words) >= n:
        whole = sum(words[j : len(words) - n + 1 + j] * SALT[j] for j in range(n))
        whole = mix(whole)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix((words[a:b] * SALT[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the n-grams' hashes over a power of two of bits, as many as n-grams or more: with fewer, sets that share
    nothing come as close as links by chance, and a large table's candidates grow into one cluster."""
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, len(tokens))))))
    return np.packbits(np.bincount(mix(tokens) & np.uint64(bits - 1), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of sizes a and b; negative where the sizes allow no link."""
    # overlap o: 100 o >= p (a + b - o), so o >= p (a + b) / (100 + p)
    need = -(-percent * (a + b) // (100 + percent))
    return np.where(need <= np.minimum(a, b), a + b - 2 * need, -1)


class Sketches:
    """Sizes and bitmaps of some rows, by bitmap width."""

    def __init__(self, size: np.ndarray, bits: list[bytes], percent: int):
        self.size, self.percent = size, percent
        self.words = np.array([len(b) // 8 for b in bits])
        self.place = np.zeros(len(bits), np.int64)
        self.table: dict[int, np.ndarray] = {}
        for w in np.unique(self.words):
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.table[int(w)] = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(-1, w)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a[i] and b[i] may link."""
        out = np.zeros(len(a), bool)
        limit = most_apart(self.size[a], self.size[b], self.percent)
        wa, wb = self.words[a], self.words[b]
        for x, y in {(int(x), int(y)) for x, y in zip(wa[limit >= 0], wb[limit >= 0], strict=True)}:
            at = np.flatnonzero((limit >= 0) & (wa == x) & (wb == y))
            w = min(x, y)
            for part in np.array_split(at, len(at) * max(x, y) // 1_000_000 + 1):
                p, q = fold(self.table[x][self.place[a[part]]], w), fold(self.table[y][self.place[b[part]]], w)
                out[part] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= limit[part]
        return out


def walk(sketch: Sketches, label: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join members into the components of `near`; members of one label are joined already."""
    edges = []
    rest = members
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            hub = todo.pop()
            hit = label[rest] == label[hub]
            other = np.flatnonzero(~hit)
            near = other[sketch.near(np.full(len(other), hub), rest[other])]
            edges += [(hub, int(x)) for x in rest[near]]
            hit[near] = True
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def candidate_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b of rows(key, row, size, bits, label), which come in order of key: near rows of different labels."""
    held: pa.Table | None = None

    def work(t: pa.Table) -> pa.RecordBatch:
        key, row, size, label = (t.column(c).to_numpy() for c in ("key", "row", "size", "label"))
        ids, first, of = np.unique(row, return_index=True, return_inverse=True)
        label = label[first]
        sketch = Sketches(size[first], t.column("bits").take(pa.array(first)).to_pylist(), percent)
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, 9):  # small groups: all groups of a size at once
            at = begin[end - begin == k]
            for i in range(k):
                for j in range(i + 1, k):
                    a.append(of[at + i])
                    b.append(of[at + j])
        a, b = np.concatenate(a), np.concatenate(b)
        new = label[a] != label[b]
        pairs = np.unique(np.stack([np.minimum(a, b)[new], np.maximum(a, b)[new]], 1), axis=0)
        pairs = pairs[sketch.near(pairs[:, 0], pairs[:, 1])]
        more = {tuple(sorted(e)) for s, z in zip(begin, end, strict=True) if z - s > 8 for e in walk(sketch, label, np.unique(of[s:z]))}
        # A forest joins the same rows with fewer edges.
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        kept = []
        for x, y in [*pairs.tolist(), *sorted(more)]:
            x, y = root(x), root(y)
            if x != y:
                parent[y] = x
                kept.append((x, y))
        kept = np.array(kept, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[kept[:, 0]]), pa.array(ids[kept[:, 1]])], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if t.num_rows < 50_000 and t.nbytes < 16 << 20:
            held = t
            continue
        key = t.column("key").to_numpy()
        last = int(np.flatnonzero(np.diff(key))[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield work(t.slice(0, last))
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield work(held)


class Trie:
    """Sets in one order, runs of elements on one edge; `live` counts the sets below a node that are still there."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: element numbers, sorted; numbers count up from the most frequent element."""
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: tuple(sets[i][:64]))
        self.label, self.kids, self.own, self.live, self.shortest, self.longest, self.parent = [], [], [], [], [], [], []
        self.home = [0] * len(sets)
        self._node(np.zeros(0, np.int64), -1)
        for i in order:
            self._insert(i)

    def _node(self, label: np.ndarray, parent: int) -> int:
        for x, v in ((self.label, label), (self.kids, {}), (self.own, []), (self.live, 0), (self.shortest, 1 << 60), (self.longest, 0), (self.parent, parent)):
            x.append(v)
        return len(self.label) - 1

    def _insert(self, i: int) -> None:
        rest, node = self.sets[i], 0
        n = len(rest)
        while True:
            self.live[node] += 1
            self.shortest[node], self.longest[node] = min(self.shortest[node], n), max(self.longest[node], n)
            if not len(rest):
                break
            kid = self.kids[node].get(int(rest[0]))
            if kid is None:
                kid = self.kids[node][int(rest[0])] = self._node(rest, node)
                rest = rest[:0]
            else:
                label = self.label[kid]
                k = min(len(label), len(rest))
                differ = np.flatnonzero(label[:k] != rest[:k])
                same = int(differ[0]) if len(differ) else k
                if same < len(label):  # split the edge
                    upper = self._node(label[:same], node)
                    self.live[upper], self.shortest[upper], self.longest[upper] = self.live[kid], self.shortest[kid], self.longest[kid]
                    self.kids[node][int(rest[0])] = upper
                    self.kids[upper][int(label[same])] = kid
                    self.label[kid], self.parent[kid] = label[same:], upper
                    kid = upper
                rest = rest[same:]
            node = kid
        self.own[node].append(i)
        self.home[i] = node

    def remove(self, i: int) -> None:
        node = self.home[i]
        self.own[node].remove(i)
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def linked(self, probe: np.ndarray, mark: np.ndarray, percent: int) -> list[int]:
        """The sets still there that link with probe; mark: a scratch array, False for every element."""
        mark[probe] = True
        n, out = len(probe), []
        stack = [(0, 0, 0)]  # node, length and overlap of the path to it
        while stack:
            node, depth, overlap = stack.pop()
            label = self.label[node]
            depth += len(label)
            overlap += int(mark[label].sum())
            out += [i for i in self.own[node] if 100 * overlap >= percent * (n + len(self.sets[i]) - overlap)]
            # The best that a set below can do: all that remains of it or of the probe is shared.
            most = overlap + min(self.longest[node] - depth, n - overlap)
            if self.live[node] > len(self.own[node]) and 100 * most >= percent * (n + max(self.shortest[node], most) - most):
                stack += [(k, depth, overlap) for k in self.kids[node].values() if self.live[k]]
        mark[probe] = False
        return out


def link(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join the sets into the components of their links."""
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return []
    values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    parts = [np.sort(x) for x in np.split(rank[number], np.cumsum(sizes)[:-1])]
    trie, mark, edges = Trie(parts), np.zeros(len(values), bool), []
    left = dict.fromkeys(i for i in range(len(sets)) if sizes[i])
    while left:
        hub = next(iter(left))
        todo = [hub]
        del left[hub]
        trie.remove(hub)
        while todo and left:
            at = todo.pop()
            for i in trie.linked(parts[at], mark, percent):
                edges.append((at, i))
                todo.append(i)
                del left[i]
                trie.remove(i)
    return edges


def text_hash(text: Column) -> Column:
    """With the id, what tells a row from others: rows that agree in both are copies."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def few(rows: DataFrame) -> DataFrame:
    """rows, which are written and narrow, to every executor if they are BROADCAST_ROWS at most; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams that are frequent in a sample of texts(t), sorted; place of each among them, the least frequent first)."""
    some = texts.filter(F.pmod(F.xxhash64("t", F.lit(9)), F.lit(SAMPLE)) == 0).select("t")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 20):
            sets = shingle_sets(b.column("t"), n)
            own = [s for s in {s.tobytes(): s for s in sets}.values() if len(s)]
            token, count = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(count)], ["token", "c"])

    counts = materialise(some.mapInArrow(emit, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= LEAST), "jaccard-frequent")
    hot = counts.orderBy(F.desc("c"), "token").limit(HOT).toArrow()
    discard(texts.sparkSession, counts)
    token = hot.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return token[order], (len(token) - order).astype(np.int64)


def blocks(n: Column | str, elements: Column | str) -> Column:
    """Into how many blocks so many rows with so many n-grams go."""
    n, elements = (F.col(c) if isinstance(c, str) else c for c in (n, elements))
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(elements / ELEMENTS)).cast("int")


def places(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each token in a filter of so many bits, a power of two."""
    h = mix(tokens.view(np.uint64) + SALT[2])
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def token_filter(tokens: DataFrame) -> np.ndarray:
    """A Bloom filter, as bytes, of tokens(token), which are written. It never misses one."""
    n, bits = tokens.count(), FILTER_PARTS * 1024
    while bits < min(MOST_BITS, FILTER_BITS * n):
        bits *= 2
    part = bits // FILTER_PARTS

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column("token").to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], ["part", "at"])

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            of, at = b.column("part").to_numpy(), b.column("at").to_numpy()
            for k in np.unique(of).tolist():
                held.setdefault(k, np.zeros(part, bool))[at[of == k]] = True
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(v, bitorder="little").tobytes()])], ["part", "bytes"])

    out = np.zeros((FILTER_PARTS, part // 8), np.uint8)
    for k, v in tokens.mapInArrow(emit, "part long, at long").repartition(FILTER_PARTS, "part").mapInArrow(fill, "part long, bytes binary").collect():
        out[k] = np.frombuffer(v, np.uint8)
    return out.ravel()


def held_by(held: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether a token is in the filter; one that isn't in it may seem to be."""
    p, q = places(tokens, 8 * len(held))
    return (held[p >> 3] >> (p & 7).astype(np.uint8) & held[q >> 3] >> (q & 7).astype(np.uint8) & 1).astype(bool)


def by_parts(rows: DataFrame, n: int, most: int, make: Callable[[DataFrame], DataFrame], name: str) -> list[DataFrame]:
    """make(rows) of each part of rows(token, ...), which has about n rows, by token: each is written, and its shuffle files go,
    before the next begins."""
    count, out = max(1, -(-n // most)), []
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("token", F.lit(7)), F.lit(count)) == k) if count > 1 else rows
        out.append(materialise(make(part), name))
        release(rows.sparkSession)
    return out


def meeting(rows: DataFrame) -> DataFrame:
    """row, size, label, token of rows(row, size, label, prefix), written: all where rows of other labels have the token in
    their prefix too, and few others."""
    spark = rows.sparkSession
    # The smallest and largest label are partial sums of two numbers, however many rows have a token.
    def of_several(part: DataFrame) -> DataFrame:
        return part.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("token")

    n = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    several = by_parts(rows.select("label", F.explode("prefix").alias("token")), n, TOKENS, of_several, "jaccard-several")
    held = spark.sparkContext.broadcast(token_filter(reduce(DataFrame.unionByName, several)))  # bounded by MOST_BITS

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            token = lists.flatten().to_numpy()
            hit = held_by(held.value, token)
            of = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[hit])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("row", "size", "label")), pa.array(token[hit])], ["row", "size", "label", "token"])

    out = materialise(rows.select("row", "size", "label", "prefix").mapInArrow(pick, "row long, size long, label long, token long"), "jaccard-meeting")
    discard(spark, *several)
    held.destroy()
    return out


def near_hubs(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, row, size, ...) with `keys`, those of the blocks a row is in: its own, or all of its group for a few
    rows, the hubs. Groups of one row are left out."""
    stats = rows.groupBy(group).agg(F.count("*").alias("__n"), F.sum("size").alias("__s")).filter("__n > 1")
    stats = materialise(stats.select(F.col(group).alias("__g"), "__n", blocks("__n", "__s").alias("__k")), "jaccard-groups")
    dealt = rows.join(few(stats), F.col(group) == F.col("__g"))
    hub = F.pmod(F.xxhash64("row", F.lit(6)), F.ceil(F.col("__n") / HUBS)) == 0
    own = F.pmod(F.xxhash64("row", F.lit(5)), F.col("__k")).cast("int")
    at = F.when((F.col("__k") > 1) & hub, F.sequence(F.lit(0), F.col("__k") - 1)).otherwise(F.array(own))
    return dealt.withColumn("keys", F.transform(at, lambda b: F.xxhash64(F.col(group), b))).drop("__g", "__n", "__k")


def across(rows: DataFrame, group: str, least: int = 1) -> DataFrame:
    """rows(group, row, size, label, ...) with `keys`, so that rows of a group that differ in label meet in a block. Groups
    of one label, and those of fewer than `least` blocks, are left out."""
    per = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    stats = per.groupBy(group).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("top")).filter("kinds > 1")
    whole = blocks("n", "s")
    most, rest = blocks("top.n", "top.s"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
    stats = stats.select(F.col(group).alias("__g"), F.col("top.label").alias("__top"), whole.alias("__k"), most.alias("__most"), rest.alias("__rest")).filter(F.col("__k") >= least)
    dealt = rows.join(few(materialise(stats, "jaccard-groups")), F.col(group) == F.col("__g"))
    g, h = F.col(group), F.xxhash64("row", F.lit(5))
    mine = F.pmod(h, F.col("__rest")).cast("int")
    each = F.sequence(F.lit(0), F.col("__rest") - 1)
    among = F.transform(each, lambda b: F.xxhash64(g, F.lit(1), F.least(mine, b), F.greatest(mine, b)))
    to_top = F.transform(F.sequence(F.lit(0), F.col("__most") - 1), lambda b: F.xxhash64(g, F.lit(2), b, mine))
    of_top = F.transform(each, lambda b: F.xxhash64(g, F.lit(2), F.pmod(h, F.col("__most")).cast("int"), b))
    keys = F.when(F.col("__k") == 1, F.array(F.xxhash64(g, F.lit(0)))).when(F.col("label") == F.col("__top"), of_top).otherwise(F.concat(among, to_top))
    return dealt.withColumn("keys", keys).drop("__g", "__top", "__k", "__most", "__rest")


def rooted(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """i, h (text_hash), size, root of each row, written: its n-gram set's size and the number of its component."""
    spark, since = docs.sparkSession, len(WRITTEN)
    bounded(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), text_hash(F.col(text_col)).alias("h"))
    hot = spark.sparkContext.broadcast(frequent(keyed, n))  # bounded by HOT

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = ((task.partitionId() if task else 0) << 36) - 1
        common, place = hot.value
        for b in pieces(batches, "t", 1 << 20):
            out: list[tuple] = []
            seen: set[bytes] = set()
            for tokens in shingle_sets(b.column("t"), n):
                row += 1
                size = len(tokens)
                one, two = (int(mix(tokens + s).sum().astype(np.int64)) if size else 0 for s in SALT[:2])
                # Of equal sets in a batch only the first is searched for: the smallest row stands for all.
                known = (mark := tokens.tobytes()) in seen
                seen.add(mark)
                if known or not size:
                    out.append((row, size, one, two, None, None, None))
                    continue
                late = np.zeros(size, bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    late = common[at] == tokens
                    tokens_late = tokens[late][np.argsort(place[at[late]])]
                    ordered = np.concatenate([tokens[~late], tokens_late])
                else:
                    ordered = tokens
                prefix = ordered[: size - -(-percent * size // 100) + 1].astype(np.int64)
                cold = min(len(prefix), int((~late).sum()))
                early = np.concatenate([prefix[: min(FIRST, cold)], prefix[cold : cold + FIRST]])
                out.append((row, size, one, two, early, prefix, bitmap(tokens)))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(),) * 4 + (pa.list_(pa.int64()),) * 2 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["i", "h", "row", "size", "one", "two", "early", "prefix", "bits"])

    sk = keyed.mapInArrow(sketch, f"i {kind}, h long, row long, size long, one long, two long, early array<long>, prefix array<long>, bits binary")
    sk = materialise(sk, "jaccard-sketches")
    copies = sk.filter("size > 0").groupBy(F.col("one").alias("__one"), F.col("two").alias("__two")).agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    copies = few(materialise(copies.filter("copies > 1").drop("copies"), "jaccard-copies"))
    marked = sk.join(copies, (F.col("one") == F.col("__one")) & (F.col("two") == F.col("__two")) & (F.col("size") > 0), "left").withColumn("rep", F.coalesce("rep", "row"))
    sought = marked.filter("prefix is not null and rep = row")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = sought.select("row", "bits")

    def candidates(dealt: DataFrame) -> DataFrame:
        """Edges among the rows of dealt(row, size, label, keys) that meet in a block and may link."""
        rows = dealt.join(bits, "row").select(F.explode("keys").alias("key"), "row", "size", "bits", "label")
        rows = rows.repartition(parts, "key").sortWithinPartitions("key")
        return rows.mapInArrow(tidy(lambda it: candidate_edges(it, percent)), "a long, b long")

    # Copies with few changes mostly share one of their first rare or first frequent elements. What these join needs no
    # edge from the others.
    first = sought.select("row", "size", F.col("row").alias("label"), F.explode("early").alias("token"))
    early = materialise(candidates(near_hubs(first, "token")).distinct(), "jaccard-early")
    found = few(materialise(components(early).select(F.col("node").alias("__node"), "root"), "jaccard-early-roots"))
    labelled = sought.join(found, F.col("row") == F.col("__node"), "left").select("row", "size", F.coalesce("root", "row").alias("label"), "prefix")
    shared = meeting(labelled)
    edges = by_parts(shared, shared.count(), SHARED, lambda part: candidates(across(part, "token")), "jaccard-edges")
    clusters = materialise(components(reduce(DataFrame.unionByName, edges, early)), "jaccard-clusters")
    discard(spark, shared)
    release(spark)

    # The sets of candidates only. Their texts are found by id and hash of text, each once a batch.
    ids = sought.select("i", "h", "row", "size").join(clusters, F.col("row") == F.col("node")).select("i", "h", "row", "size", "root")
    ids = materialise(ids, "jaccard-candidates")

    @tidy
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", 1 << 20):
            _, once = np.unique(b.column("row").to_numpy(), return_index=True)
            b = b.take(pa.array(once))
            sets = shingle_sets(b.column("t"), n)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("keys"), b.column("row"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["keys", "row", "tokens"])

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sets = None, [], []

        def done() -> pa.RecordBatch:
            by_row = dict(zip(rows, sets, strict=True))
            own = list(by_row)
            pairs = link(list(by_row.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array([own[a] for a, _ in pairs], pa.int64()), pa.array([own[b] for _, b in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("tokens").offsets.to_numpy()
            flat = b.column("tokens").values.to_numpy().view(np.uint64)
            for j, (k, r) in enumerate(zip(b.column("key").to_pylist(), b.column("row").to_pylist(), strict=True)):
                if k != key and rows:
                    yield done()
                    rows, sets = [], []
                key = k
                rows.append(r)
                sets.append(flat[at[j] : at[j + 1]].copy())
        if rows:
            yield done()

    def linked(dealt: DataFrame) -> DataFrame:
        """Edges among the rows of dealt(i, h, row, keys) that meet in a block and link."""
        dealt = few(materialise(dealt.select(F.col("i").alias("__id"), F.col("h").alias("__h"), "row", "keys"), "jaccard-dealt"))
        texts = keyed.join(dealt, F.col("i").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("keys", "row", "t")
        sets = texts.mapInArrow(sets_of, "keys array<long>, row long, tokens array<long>").select(F.explode("keys").alias("key"), "row", "tokens")
        return sets.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")

    links = materialise(linked(near_hubs(ids, "root")), "jaccard-links")
    release(spark)
    large = ids.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s")).filter(blocks("n", "s") > 1)
    if not large.isEmpty():
        joined = components(links).select(F.col("node").alias("__node"), F.col("root").alias("label"))
        joined = few(materialise(joined, "jaccard-labels"))
        rows = ids.join(joined, F.col("row") == F.col("__node"), "left").select("i", "h", "row", "size", "root", F.coalesce("label", "row").alias("label"))
        links = links.unionByName(linked(across(rows, "root", least=2)))
    roots = few(materialise(components(links).select(F.col("node").alias("__node"), "root"), "jaccard-roots"))
    out = marked.join(roots, F.col("rep") == F.col("__node"), "left").select("i", "h", "size", F.coalesce("root", "rep").alias("root"))
    out = materialise(out, "jaccard-components")
    hot.destroy()
    discard(spark, since=since, keep=out)
    release(spark)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id of each row: two rows link when their n-gram sets' Jaccard similarity is percent/100 or more."""
    out = rooted(docs, id_col, text_col, n, percent)
    least = out.groupBy(F.col("root").alias("__root")).agg(F.min("i").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    least = few(materialise(least.drop("n"), "jaccard-least"))
    # Rows alone have themselves; a group without any id has none.
    id_ = F.when(F.col("__root").isNull(), F.col("i")).otherwise(F.col("component_id"))
    return out.join(least, F.col("root") == F.col("__root"), "left").select(F.col("i").alias(id_col), F.col("size").alias("n_shingles"), id_.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest id (null ids last); of rows that repeat an id and its text, one.

    Blank texts without an id are components of their own, and all stay.
    """
    found = rooted(docs, id_col, text_col, n, percent)
    key = F.struct(F.col("i").isNull().alias("none"), "i", "h")
    best = found.groupBy(F.col("root").alias("__root")).agg(F.min(key).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = few(materialise(best.drop("n"), "jaccard-best"))
    rest = found.join(best, F.col("root") == F.col("__root")).filter(~key.eqNullSafe(F.col("best"))).select(F.col("i").alias("__id"), F.col("h").alias("__h")).distinct()
    rest = few(materialise(rest, "jaccard-rest"))
    kept = docs.withColumn("__text", text_hash(F.col(text_col)))
    kept = kept.join(rest, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left_anti")
    if found.groupBy("i", "h").count().filter("count > 1").isEmpty():
        return kept.drop("__text")
    blank = F.col(id_col).isNull() & ~F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn("__own", F.when(blank, F.monotonically_increasing_id()))
    return kept.dropDuplicates([id_col, "__text", "__own"]).drop("__text", "__own")
