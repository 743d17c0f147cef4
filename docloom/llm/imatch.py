"""I-Match document fingerprints; DataFrame functions only.

Document frequencies are counted over all documents. The lexicon keeps terms whose share of documents lies in a band;
since a document has so many different terms, at most (terms a document) / LOW can have a share of LOW, so the lexicon's
size doesn't follow the corpus. It is arranged as a hash table in one array, which each task gets as the value of a
scalar subquery: plans, which Spark prints again and again, don't hold it. A band of more than `TERMS` terms is refused.

A document's terms in the lexicon are made distinct and sorted, and the sorted terms of each of several random subsets
of the lexicon are hashed with 64 bits: `WIDE` overlapping subsets, each with three quarters of all terms, which agree
for texts that differ in few terms, and 16 subsets at each of four rates, so that short and long documents alike have
subsets with a few of their terms and a text edited by half still has some in common. The 16 of the first rate take
every term; subsets and rates choose independently. The fingerprint lists the subsets that have a term, with their
hashes; the likeness of two fingerprints is the share of common entries among all.

The next document is found without a global window: ids are dealt into ranges by their quantiles, each range finds its
own neighbours, and the first row of each range is passed to the range before. Rows that share a very frequent id, or
have none, are ordered and dealt by their texts' hashes.

Nulls and edges: null text is empty; an empty text and a text without a lexicon term have one entry, the hash of their
distinct sorted terms, so that equal texts agree and others don't; documents with equal ids follow in order of their
texts' hashes, null ids come last; a table of one row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

LOW, HIGH, TERMS, WIDE = 0.001, 0.2, 1_000_000, 4
#: Into how many cells each rate deals all terms; its subsets are the first 16 cells, so those of the first have every term.
RATES = (16, 64, 256, 1024)
#: For each rate, the subset of a term by ten bits of its hash, '-' where it has none (no term begins so).
SUBSETS = [" ".join(f"{16 * rate + k % n:02d}:" if k % n < 16 else "-" for k in range(1024)) for rate, n in enumerate(RATES)]


def terms_of(text: Column) -> Column:
    """The distinct terms (runs of letters and digits, lower-cased)."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> Column:
    """One array of arrays of terms, as a scalar subquery; a term is in place xxhash64(term) mod size."""
    counts = docs.select(F.explode(terms_of(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    n = docs.count()
    band = materialise(counts.filter((F.col("df") >= n * low) & (F.col("df") <= max(2, n * high))).select("w"), "imatch-lexicon")
    size = band.count()
    if size > TERMS:
        raise ValueError(f"{size} terms lie in the band; every task holds them, so raise `low`")
    slots = 1 << max(1, size).bit_length()
    held = band.select(F.pmod(F.xxhash64("w"), F.lit(slots)).alias("slot"), F.array("w").alias("ws"))
    free = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), F.array().cast("array<string>").alias("ws"))
    each = held.unionByName(free).groupBy("slot").agg(F.flatten(F.collect_list("ws")).alias("ws"))
    table = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "ws"))), lambda x: x["ws"]).alias("table"))  # bounded by the band
    return materialise(table, "imatch-table").scalar()


def fingerprint(text: Column, table: Column) -> Column:
    """Entries `subset:hash` of a text, sorted, as an array. Names text and table once each."""

    def known(terms: Column) -> Column:
        one = F.transform(F.array(table), lambda held: F.filter(terms, lambda w: F.array_contains(F.element_at(held, F.pmod(F.xxhash64(w), F.size(held)).cast("int") + 1), w)))
        return F.element_at(one, 1)

    def coded(w: Column, rate: int) -> Column:
        # Ten bits of the hash for each rate, from the high end: the low ones choose the place in the table.
        place = F.shiftright(F.xxhash64(w), 54 - 10 * rate).bitwiseAND(F.lit(1023)).cast("int")
        return F.concat(F.element_at(F.split(F.lit(SUBSETS[rate]), " "), place + 1), w)

    def printed(name: Column, words: Column) -> Column:
        return F.concat(name, F.lpad(F.hex(F.xxhash64(words)), 16, "0"))

    def entries(own: Column) -> Column:
        each = F.transform(own, lambda w: F.filter(F.array(*[coded(w, r) for r in range(len(RATES))]), lambda e: ~F.startswith(e, F.lit("-"))))
        # One run for each subset: in order, the terms of a subset stand together.
        runs = F.regexp_extract_all(F.array_join(F.array_sort(F.flatten(each)), " "), F.lit(r"(\d\d):[^ ]+(?: \1:[^ ]+)*"), F.lit(0))
        # A wide subset leaves out the terms that have two certain bits of another hash clear.
        def wider(k: int) -> Column:
            return F.array_join(F.filter(own, lambda w: F.shiftright(F.xxhash64(w, F.lit(1)), 2 * k).bitwiseAND(F.lit(3)) != 0), " ")

        wide = [wider(k) for k in range(WIDE)]
        wide = F.filter(F.array(*[F.when(x != "", printed(F.lit(f"w{k}"), x)) for k, x in enumerate(wide)]), lambda e: e.isNotNull())
        return F.concat(wide, F.transform(runs, lambda r: printed(F.substring(r, 1, 2), r)))

    def printed_terms(terms: Column) -> Column:
        hashed = F.element_at(F.transform(F.array(F.array_sort(known(terms))), entries), 1)
        alone = F.array(F.concat(F.lit("zz"), F.hex(F.xxhash64(F.array_join(F.array_sort(terms), " ")))))
        return F.element_at(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, h).otherwise(alone)), 1)

    # Through lists of one, so that each is computed once.
    return F.element_at(F.transform(F.array(terms_of(text)), printed_terms), 1)


def with_table(rows: DataFrame, table: Column, name: str, value: Callable[[Column], Column]) -> DataFrame:
    """rows with value(table) as column `name`.

    No subquery may be written within a lambda, so it is a column at first. The optimizer puts it where that column stands
    if `value` names it once and no computed column of `rows` twice; else each row would carry the whole table.
    """
    return rows.withColumn("__table", table).withColumn(name, value(F.col("__table"))).drop("__table")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def neighbours(docs: DataFrame, id_col: str, text_col: str, extra: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """i, t, e, next: each text, e as `extra` adds it to rows with column t, and t and e of the document with the next
    smaller id; after the last comes the first."""
    bare = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    found = docs.select(F.col(id_col).alias("i")).agg(F.percentile_approx("i", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000)).first()[0] or []
    cuts = sorted(set(found), reverse=True)
    # An id that is several quantiles, and the null id, go on in that many ranges of their texts' hashes.
    hot = [c for c in cuts if found.count(c) > 1]
    slice_ = F.floor((F.shiftright("h", 32) + (1 << 31)) / float(1 << 32) * parts).cast("int")
    at = F.size(F.filter(F.lit(cuts), lambda c: F.col("i") < c)) if cuts else F.lit(0)
    at = F.when(F.col("i").isNull(), len(cuts) + 1).otherwise(at) * 2
    split = F.col("i").isNull() | (F.col("i").isin(hot) if hot else F.lit(False))
    # Ids between two cuts come before the smaller one itself.
    at = at + (F.when(F.col("i").isin(cuts), 1).otherwise(0) if cuts else 0)
    bare = bare.withColumn("p", at.cast("long") * (parts + 1) + F.when(split, slice_).otherwise(0))
    window = Window.partitionBy("p").orderBy(F.desc_nulls_last("i"), "h")
    ranged = extra(bare).withColumns({"next": F.lead(F.struct("t", "e")).over(window), "last": F.lead(F.lit(1)).over(window).isNull()})
    # The first row of each range, by keys alone: a few ranges for each partition, so few rows.
    key = F.struct(F.col("i").isNotNull(), F.col("i"), -F.col("h").cast("decimal(20,0)"))
    first = materialise(bare.groupBy("p").agg(F.max_by(F.struct("i", "h"), key).alias("first")).select(F.col("p").alias("q"), "first.*"), "imatch-firsts")
    first = first.withColumnsRenamed({"i": "__i", "h": "__h"})
    texts = bare.join(F.broadcast(first), (F.col("p") == F.col("q")) & F.col("i").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h")))
    texts = extra(texts.groupBy("p").agg(F.first("t").alias("t"))).withColumn("first", F.struct("t", "e"))
    ring = Window.orderBy("p")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = texts.select(F.col("p").alias("q"), F.coalesce(F.lead("first").over(ring), F.min_by("first", "p").over(every)).alias("after"))
    after = materialise(after, "imatch-ranges")
    return ranged.join(F.broadcast(after), (F.col("p") == F.col("q"))).select("i", "t", "e", F.when(F.col("last"), F.col("after")).otherwise(F.col("next")).alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """id, fingerprint of each text."""
    table = lexicon(docs, text_col, low, high)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = with_table(rows, table, "e", lambda held: fingerprint(F.coalesce("t", F.lit("")), held))
    return rows.select(F.col("i").alias(id_col), F.array_join("e", "-").alias("fingerprint"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text with itself edited
    (its last half replaced by the beginning of the next document) and with the next document."""
    table = lexicon(docs, text_col, low, high)
    rows = neighbours(docs, id_col, text_col, lambda some: with_table(some, table, "e", lambda held: fingerprint(F.col("t"), held)))
    rows = rows.select("i", "t", F.col("e").alias("a"), F.col("next.t").alias("other"), F.col("next.e").alias("c"))
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr("other", F.lit(1), half))

    def made(held: Column) -> Column:
        return F.element_at(F.transform(F.array(edited), lambda x: F.struct(F.sha2(x, 256).alias("edited_sha256"), fingerprint(x, held).alias("b"))), 1)

    rows = with_table(rows, table, "made", made).select("i", n.cast("long").alias("n_chars"), "made.edited_sha256", "a", "made.b", "c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select(F.col("i").alias(id_col), "n_chars", "edited_sha256", F.array_join(a, "-").alias("fingerprint"), F.array_join(b, "-").alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
