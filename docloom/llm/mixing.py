"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a fixed 60-bit hash. Words are summed by source and hash bucket, the bucket in which a source's
budget ends is found from the running sum, and only that bucket is split further by 256, `LEVELS` times and then on as
long as such a bucket has several documents. The cut falls between two documents, and taking a document is a filter on
its hash: nothing is sorted and no two documents of a source need to meet. Sums are combined before the shuffle, so a source that holds a third of all
rows sends 256 rows a task at most.

Nulls and edges: a null text has size 0; a null source is a source of its own, last in order; a null id hashes as the
empty text; repeated rows hash alike and are taken together; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

BITS, LEVELS, HASH_BITS, SOURCES = 8, 3, 60, 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """__key, source_size, target for each source of sizes(__key, size): shares of all words by weight, at most `most`
    times a source's words, the excess reshared by weight. Sources weigh weights[0], weights[1], ... in order of __key.

    With sources in order of size/weight, those whose equal share exceeds the limit come first, so the level at which
    the rest share is a running sum over sources. That window has one row for each source, not for each document.
    """
    per = sizes.groupBy("__key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("__key"))
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy((F.col("source_size").cast("double") / F.col("__w")), "__key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    per = per.withColumns({"__all": F.sum("source_size").over(everything), "__weights": F.sum("__w").over(everything), "__s": F.coalesce(F.sum("source_size").over(before), zero), "__ws": F.coalesce(F.sum("__w").over(before), zero)})
    left, rest = F.col("__all") - most * F.col("__s"), F.col("__weights") - F.col("__ws")
    per = per.withColumns({"__left": left, "__rest": rest, "__over": left * F.col("__w") > most * F.col("source_size") * rest})
    per = per.withColumn("__level", F.min(F.when(~F.col("__over"), F.struct("__ws", "__left", "__rest"))).over(everything))
    share = F.col("__level.__left").cast("double") * F.col("__w") / F.col("__level.__rest")
    return per.select("__key", "source_size", F.when(F.col("__over"), (most * F.col("source_size")).cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def _cut(level: DataFrame, per: DataFrame, step: int) -> DataFrame:
    """per with the first bucket of this level that doesn't fit into what is left of the budget, and the budget then left."""
    bucket = F.shiftright("__h", HASH_BITS - BITS * (step + 1)) % (1 << BITS)
    sums = level.groupBy("__key", bucket.alias("__b")).agg(F.sum("size").alias("__n"))
    running = F.sum("__n").over(Window.partitionBy("__key").orderBy("__b"))
    sums = sums.withColumn("__run", running).join(per, "__key")
    fits = F.col("__run") <= F.col("__budget")
    found = sums.groupBy("__key").agg(F.min(F.when(~fits, F.col("__b"))).alias("__edge"), F.coalesce(F.max(F.when(fits, F.col("__run"))), F.lit(0)).alias("__used"), F.min(F.when(~fits, F.col("__n"))).alias("__least"))
    found = found.select("__key", F.coalesce("__edge", F.lit(1 << BITS)).alias("__edge"), "__used")
    per = per.join(found, "__key", "left")
    return per.select("__key", "source_size", "target", "__full", (F.col("__from") + F.coalesce("__edge", F.lit(0)) * (1 << (HASH_BITS - BITS * (step + 1)))).alias("__from"), (F.col("__budget") - F.coalesce("__used", F.lit(0))).alias("__budget"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    # A null source gets a key after every other one.
    key = F.when(F.col(source_col).isNull(), F.lit("w")).otherwise(F.concat(F.lit("v"), F.col(source_col)))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return [key.alias("__key"), size_of(F.col(text_col)).alias("size"), h.alias("__h")]


def cuts(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """__key, source_size, target, __full, __from by source of sizes(__key, size, __h): documents are taken __full times,
    those whose hash is below __from once more."""
    per = source_targets(sizes, weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("__full", full).withColumns({"__from": F.lit(0).cast("long"), "__budget": F.col("target") - F.col("__full") * F.col("source_size")})
    some = sizes.filter(F.col("size") > 0)
    level = some
    for step in range(HASH_BITS // BITS):
        if step >= LEVELS and level.groupBy("__key").agg(F.min("__h").alias("a"), F.max("__h").alias("b")).filter("a < b").isEmpty():
            break
        per = materialise(_cut(level, per, step), f"mix-cut{step}")
        width = 1 << (HASH_BITS - BITS * (step + 1))
        level = some.join(_sent(per.select("__key", "__from")), "__key").filter((F.col("__h") >= F.col("__from")) & (F.col("__h") < F.col("__from") + width)).drop("__from")
    # The last bucket, mostly one document, is taken if that comes nearer to the target than leaving it.
    last = level.groupBy("__key").agg(F.sum("size").alias("__last"))
    per = per.join(last, "__key", "left").withColumn("__from", F.col("__from") + F.when(2 * F.col("__budget") >= F.col("__last"), F.lit(width)).otherwise(F.lit(0)))
    return materialise(per.drop("__budget", "__last"), "mix-cuts")


def _sent(per: DataFrame) -> DataFrame:
    """per, to every executor if it has few sources; else the join shuffles, and AQE splits a hot source."""
    return F.broadcast(per) if per.count() <= SOURCES else per


def _repeats(size: Column) -> Column:
    """How often a document is taken; one without words at most once."""
    n = F.col("__full") + (F.col("__h") < F.col("__from")).cast("long")
    return F.when(size > 0, n).otherwise(F.least(n, F.lit(1)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each document: id, size, source_size, target, repeats (0 to `most`), taken = repeats * size."""
    sizes = materialise(docs.select(F.col(id_col).alias("__id"), *_keyed(docs, id_col, text_col, source_col)), "mix-sizes")
    out = sizes.join(_sent(cuts(sizes, weights, most)), "__key").withColumn("repeats", _repeats(F.col("size")))
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents as the mix takes them: none, once or up to `most` times each. Their texts aren't shuffled."""
    key, size, h = _keyed(docs, id_col, text_col, source_col)
    per = cuts(materialise(docs.select(key, size, h), "mix-sizes"), weights, most).select("__key", "__full", "__from")
    taken = docs.select("*", key, size.alias("__size"), h).join(_sent(per), "__key").withColumn("__n", _repeats(F.col("__size"))).filter("__n > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
