"""Language-model scores by prediction by partial matching (PPM) over bytes.

The trie of contexts is a table of byte strings with counts: strings of ORDER + 1 bytes are counted over all training
texts (each text preceded by zero bytes), shorter ones follow by leaving out the oldest byte. A byte is coded in the
longest context seen; if it is new there, an escape (method C: as probable as the number of different bytes seen) leads
to the next shorter context, where the bytes of the longer one are excluded, down to all bytes alike. Since the bytes
seen in a context are a subset of those seen in its suffix, what exclusion leaves of a context depends only on the
context from which it is entered. So each node's terms are computed once and a text's code length is a sum of lookups.

The adaptive form, `adaptive`, starts from an empty trie for each text and counts as it goes.

Counts cover all training rows and are combined on the executors. The trie is a table of all its nodes and no node is
left out, so it grows with the corpus. Every worker gets the log probabilities of the most frequent strings of
ORDER + 1 bytes, `NODES` at most, found from a histogram of counts. What isn't among them, rare or new, is counted for
each document and joined by key with its log probability, which is computed once for each different string from the
whole trie: nodes with the same last bytes of context stand together, and what the orders below need of them is the
table of strings of up to SHARED bytes.

The base score needs the count of every token. Frequent tokens, `FREQUENT` at most, are looked up where the text is;
the rest, few in number, are joined by token, summed for each document before they are sent back.

Nulls and edges: null text is the empty text, which has one token (the end) and probability 1 in bytes; without
training rows every byte has probability 1/256 and N = V = 0 (the base score is then 0, since no token is known).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BYTE_LOWER, WORD, ascii_lower, bounded, materialise, pieces, text_bytes

ORDER, NODES, FREQUENT = 5, 2_000_000, 150_000
#: Orders whose nodes go to every worker (strings of up to so many bytes), and the rows for which one piece of the trie is built.
SHARED, PIECE = 3, 500_000
LOWER = np.frombuffer(BYTE_LOWER, np.uint8)
WORDS = re.compile(WORD)
END = "\n"  # stands for the end of a text: it can't occur within a word


def windows(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each byte of lower-cased data the byte with the ORDER bytes before it, as one number; zero bytes before a text."""
    low = LOWER[data].astype(np.uint64)
    key = low.copy()
    for j in range(1, ORDER + 1):
        back = np.zeros_like(low)
        back[j:] = low[:-j]
        for k in range(j):  # the first bytes of a text don't see the text before
            at = offsets[:-1] + k
            back[at[at < offsets[1:]]] = 0
        key |= back << np.uint64(8 * j)
    return key


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, n: how often each string of ORDER + 1 bytes occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n).astype(np.int64)

        for b in pieces(batches, "t", 1 << 20):
            offsets, data = text_bytes(b.column("t"))
            if len(data):
                held.append(np.unique(windows(offsets, data), return_counts=True))
            if len(held) > 8:
                held = [joined()]
        if held:
            keys, n = joined()
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].astype(np.int64)), pa.array(n[a : a + 100_000])], ["key", "n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Trie:
    """The nodes of each order: sorted keys, the log probability of a byte seen there, and the terms of escapes."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables[j]: sorted keys of j + 1 bytes and counts. Each context has all its bytes, and its suffixes are there."""
        self.keys, self.own, self.count, self.ctx, self.escape, self.down, self.left = [], [], [], [], [], [], []
        eight = np.uint64(8)
        below: tuple[np.ndarray, ...] = ()
        for j, (keys, n) in enumerate(tables):
            ctx, first, kinds = np.unique(keys >> eight, return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            at = np.searchsorted(ctx, keys >> eight)
            self.keys.append(keys)
            self.count.append(np.log10(n))
            self.own.append(np.log10(n) - np.log10(total[at] + kinds[at]))
            self.ctx.append(ctx)
            # The first escape from a context, and what is left of its suffix's total once its bytes are excluded.
            self.escape.append(np.log10(kinds) - np.log10(total + kinds))
            if j:
                low_ctx, low_total, low_kinds = below
                low, low_n = tables[j - 1]
                taken = np.bincount(at, low_n[np.searchsorted(low, keys & np.uint64((1 << 8 * j) - 1))], len(ctx))
                suffix = np.searchsorted(low_ctx, ctx & np.uint64((1 << 8 * (j - 1)) - 1))
                new = low_kinds[suffix] - kinds
                rest = low_total[suffix] - taken + new
                self.left.append(np.log10(np.maximum(rest, 1)))
                self.down.append(np.where(new > 0, np.log10(np.maximum(new, 1)) - np.log10(np.maximum(rest, 1)), 0.0))
            else:
                self.left.append(np.log10(np.maximum(256 - kinds, 1)))
                self.down.append(np.zeros(len(ctx)))
            below = ctx, total, kinds

    def bytes_log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability, given keys of windows()."""
        if not self.keys or not len(self.keys[0]):
            return np.full(len(keys), -math.log10(256))
        out = np.zeros(len(keys))
        todo, k = np.arange(len(keys)), keys
        entered = np.full(len(todo), -1)  # the longer context from which a byte escaped, if any
        for j in range(len(self.keys) - 1, -1, -1):
            if not len(todo):
                return out
            if not len(self.keys[j]):
                continue
            mine = k & np.uint64((1 << 8 * (j + 1)) - 1)
            place = np.minimum(np.searchsorted(self.keys[j], mine), len(self.keys[j]) - 1)
            hit = self.keys[j][place] == mine
            first = entered < 0
            now, later = hit & first, hit & ~first
            out[todo[now]] += self.own[j][place[now]]
            if later.any():
                out[todo[later]] += self.count[j][place[later]] - self.left[j + 1][entered[later]]
            context = mine >> np.uint64(8)
            c = np.minimum(np.searchsorted(self.ctx[j], context), len(self.ctx[j]) - 1)
            known = (self.ctx[j][c] == context) & ~hit
            now, later = known & first, known & ~first
            out[todo[now]] += self.escape[j][c[now]]
            if later.any():
                out[todo[later]] += self.down[j + 1][entered[later]]
            entered = np.where(known, c, -1)[~hit]
            todo, k = todo[~hit], k[~hit]
        out[todo] -= self.left[0][0]
        return out


class Frequent:
    """Strings of ORDER + 1 bytes and the log probability of the last byte, by open addressing."""

    def __init__(self, keys: np.ndarray, own: np.ndarray):
        self.keys, self.own = keys, own
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self.spread(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def spread(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self.spread(keys)
        out = self.slots[slot]
        todo = np.flatnonzero(out >= 0)
        todo = todo[self.keys[out[todo]] != keys[todo]]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[slot[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[self.keys[out[todo]] != keys[todo]]
        return out


def nodes(grams: DataFrame) -> DataFrame:
    """j, key, n: all nodes of the trie of gram_counts(), strings of j + 1 bytes."""
    mask = F.element_at(F.array(*[F.lit((1 << 8 * (j + 1)) - 1) for j in range(ORDER + 1)]), F.col("j") + 1)
    each = grams.select(F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("j"), "key", "n")
    return materialise(each.groupBy("j", F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")), "ppm-nodes")


def arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns key and n in order of key."""
    t = rows.select("key", "n").toArrow()
    key, n = t.column("key").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(float)
    order = np.argsort(key)
    return key[order], n[order]


def most_frequent(each: DataFrame, most: int) -> Frequent:
    """The most frequent strings of ORDER + 1 bytes among nodes(), `most` at most."""
    top = each.filter(F.col("j") == ORDER)
    size = F.floor(F.log2("n") * 4)
    room, least = most, 1 << 30
    for r in top.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 256 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    fits = size >= least
    keys, n = arrays(top.filter(fits))
    sums = top.groupBy(F.shiftright("key", 8).alias("key")).agg((F.sum("n") + F.count("*")).alias("n"), F.max(fits).alias("kept")).filter("kept")
    ctx, all_of = arrays(sums)
    return Frequent(keys, (np.log10(n) - np.log10(all_of[np.searchsorted(ctx, keys >> np.uint64(8))])).astype(np.float32))


def rare(each: DataFrame, asked: DataFrame) -> DataFrame:
    """key, log: log10 of the last byte's probability in the trie of nodes() for each row of asked(key)."""
    spark = each.sparkSession
    low = spark.sparkContext.broadcast([arrays(each.filter(F.col("j") == j)) for j in range(SHARED)])  # bounded by 256^SHARED
    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("g")
    rows = each.filter(F.col("j") >= SHARED).select(group, "j", "key", "n").unionByName(asked.select(group, F.lit(-1).alias("j"), "key", F.lit(0).cast("long").alias("n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(g: np.ndarray, j: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            wanted = key[j < 0]
            if not len(wanted):
                return
            here = np.isin(g, g[j < 0])
            tables = list(low.value)
            for o in range(SHARED, ORDER + 1):
                at = np.flatnonzero(here & (j == o))
                at = at[np.argsort(key[at])]
                tables.append((key[at].astype(np.uint64), n[at].astype(float)))
            logs = Trie(tables).bytes_log10(wanted.astype(np.uint64))
            for a in range(0, len(wanted), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(wanted[a : a + 100_000]), pa.array(logs[a : a + 100_000])], ["key", "log"])

        held: list[list[np.ndarray]] = []
        size, most = 0, PIECE
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size < most:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
            yield from done(*(x[:cut] for x in whole))
            held, size = [[x[cut:] for x in whole]], size - cut
            most = max(PIECE, 2 * size)
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(solve, "key long, log double")


def missing(offsets: np.ndarray, at: np.ndarray, keys: np.ndarray) -> pa.Array:
    """For each text the different keys at the places `at`, and how often each occurs."""
    text = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((keys[at], text))
    text, key = text[order], keys[at][order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(at) else at
    pairs = pa.StructArray.from_arrays([pa.array(key[new].astype(np.int64)), pa.array(np.diff(np.append(new, len(at))))], ["key", "m"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(len(offsets))).astype(np.int32)), pairs)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """w, c: the tokens of all texts and how often each occurs; END once for each text."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"({WORD})"), F.lit(1))
    return docs.select(F.explode(F.concat(words, F.array(F.lit(END)))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of each whole text; the model learns where `train` holds."""
    spark = docs.sparkSession
    bounded(spark)
    learn = docs.filter(train)
    each = nodes(gram_counts(learn, text_col))
    bare = each.isEmpty()
    top = spark.sparkContext.broadcast(most_frequent(each, NODES))  # bounded by NODES
    vocabulary = materialise(token_counts(learn, text_col), "ppm-tokens")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("c") * 8)
    room, least = FREQUENT, 1 << 30
    for r in vocabulary.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 512 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    frequent = vocabulary.filter(size >= least).toArrow()  # bounded by FREQUENT
    known = spark.sparkContext.broadcast(dict(zip(frequent.column("w").to_pylist(), frequent.column("c").to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, count = top.value, known.value
        logs = {w: math.log10(c + 0.5) for w, c in count.items()}
        for b in pieces(batches, "t", 1 << 20):
            offsets, data = text_bytes(b.column("t"))
            keys = windows(offsets, data)
            place = model.find(keys)
            lost = place < 0
            each_log = np.full(len(keys), -math.log10(256) if bare else 0.0)
            each_log[~lost] = model.own[place[~lost]]
            sums = np.concatenate([[0.0], np.cumsum(each_log)])
            code = sums[offsets[1:]] - sums[offsets[:-1]]
            missed = missing(offsets, np.zeros(0, np.int64) if bare else np.flatnonzero(lost), keys)
            n, base, rest, found = [], [], [], []
            for t in b.column("t").to_pylist():
                words = tokens(t)
                words.append(END)
                got = list(map(logs.get, words))
                other = [w for w, x in zip(words, got, strict=True) if x is None] if None in got else []
                n.append(len(words))
                found.append(len(words) - len(other))
                base.append(math.fsum(x for x in got if x is not None))
                rest.append(list(Counter(other).items()))
            flat = [p for r in rest for p in r]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.int64())], ["w", "n"])
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(code, pa.float64()), pa.ListArray.from_arrays(pa.array(at), pairs), missed], ["i", "n_tokens", "found", "base", "score", "rest", "missed"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, n_tokens long, found long, base double, score double, rest array<struct<w: string, n: long>>, missed array<struct<key: long, m: long>>")
    # A row's number in its file stands for it: ids may repeat or be null.
    out = materialise(out.withColumn("row", F.monotonically_increasing_id()), "ppm-scores")
    others = out.select("row", F.inline("rest"))
    others = others.join(vocabulary, "w").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("logs"))
    missed = out.select("row", F.inline("missed"))
    missed = missed.join(rare(each, missed.select("key").distinct()), "key").groupBy("row").agg(F.sum(F.col("m") * F.col("log")).alias("tail"))
    some = out.drop("rest", "missed").join(others, "row", "left").join(missed, "row", "left")
    n_known = F.col("found") + F.coalesce("more", F.lit(0))
    unknown = F.col("n_tokens") - n_known
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) + unknown * math.log10(0.5) - F.col("n_tokens") * math.log10(total + 0.5 * (kinds + 1))
    return some.select(F.col("i").alias(id_col), "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"))


def tokens(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased, between ASCII white space."""
    if not text:
        return []
    return WORDS.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))


def adaptive(texts: list[str | None], order: int = ORDER) -> list[float]:
    """log10 of each text's probability under a trie that starts empty and counts the text as it goes."""
    out = []
    for text in texts:
        data = (text or "").translate(ASCII_LOWER).encode()
        seen: list[dict[bytes, Counter]] = [defaultdict(Counter) for _ in range(order + 1)]
        total = 0.0
        for i, c in enumerate(data):
            excluded: set[int] = set()
            for j in range(min(order, i), -1, -1):
                here = seen[j].get(data[i - j : i])
                if here is None:
                    continue
                left = {b: n for b, n in here.items() if b not in excluded}
                if not left:
                    continue
                all_of = sum(left.values()) + len(left)
                if c in left:
                    total += math.log10(left[c] / all_of)
                    break
                total += math.log10(len(left) / all_of)
                excluded |= left.keys()
            else:
                total -= math.log10(256 - len(excluded))
            for j in range(min(order, i) + 1):
                seen[j][data[i - j : i]][c] += 1
        out.append(total)
    return out
