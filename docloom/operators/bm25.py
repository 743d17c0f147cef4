"""BM25 over several fields: a query over texts without an index, and a postings index for repeated queries.

Scores use exact field lengths, k1 = 1.2 and b = 0.75. A query's terms are counted where a text is read, and each text
is split into tokens once a pass: nothing is shuffled but one row of statistics, and the best rows are picked by a
partial top-n. The index counts a text's terms within its row, too.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.tokens import MOST_BYTES, QUERY_CHARS, is_howto, once, tokens

K1, B = 1.2, 0.75
#: Fields and boosts.
BOOSTS = {"content": 1.0, "title": 2.0, "heading": 1.6}
#: Fragments of a source's name, whether only for how-to queries, and the factor.
FACTORS = (("_changelog_", False, 0.15), ("platform__architecture", True, 0.6), ("__reference__", True, 0.75))
ACTIONABLE = ("sdk__tools", "sdk__app_development", "software_development__guides")
ACTIONABLE_FACTOR = 1.15


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, as tokens() makes them."""
    low = re.sub(f"[{re.escape(QUERY_CHARS)}]", " ", query.lower())
    found = re.findall(r"[^\W_]+", low)
    return list(dict.fromkeys(t for t in found if len(t.encode()) < MOST_BYTES))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def occurrences(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def scores(docs: DataFrame, query: str, fields: dict[str, str], boosts: dict[str, float] | None = None) -> DataFrame:
    """docs with `score` where a term occurs. fields: field name to column; statistics are those of docs."""
    boosts = boosts or BOOSTS
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)

    def count(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), F.array(*[occurrences(words, t) for t in terms]).alias("f"))

    # An explode of one element keeps the optimizer from copying the counts into each place that refers to them.
    one = F.struct(*[once(tokens(F.coalesce(F.col(c), F.lit(""))), count).alias(f) for f, c in fields.items()])
    counted = docs.select("*", F.explode(F.array(one)).alias("__c"))
    wanted = [F.count("*").alias("n")]
    for f in fields:
        wanted += [F.avg(f"__c.{f}.n").alias(f"m_{f}")] + [F.count_if(F.col(f"__c.{f}.f")[i] > 0).alias(f"d_{f}_{i}") for i in range(len(terms))]
    stats = counted.agg(*wanted).first().asDict()  # one row
    score = F.lit(0.0)
    for f in fields:
        for i in range(len(terms)):
            tf = F.col(f"__c.{f}.f")[i]
            part = boosts.get(f, 1.0) * idf(F.lit(float(stats["n"])), F.lit(float(stats[f"d_{f}_{i}"]))) * tf_norm(tf, F.col(f"__c.{f}.n"), F.lit(stats[f"m_{f}"] or 1.0))
            score = score + F.when(tf > 0, part).otherwise(0.0)
    out = counted.withColumn("score", score).filter("score > 0")
    return out.select(*docs.columns, "score")


def ranked(rows: DataFrame, n: int, by: str = "score", id_col: str = "id") -> DataFrame:
    """The n best rows with `rank`; ties go to the smaller id."""
    best = rows.orderBy(F.desc(by), F.asc(id_col)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.asc(id_col))))


def held(rows: DataFrame) -> DataFrame:
    """A ranking's rows, as few as its limit, as a local table: whatever reads them doesn't rank again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def top(docs: DataFrame, query: str, n: int, fields: dict[str, str] | None = None, version: str | None = None, id_col: str = "id") -> DataFrame:
    """The n best documents of a version (of all, without one). Statistics are those of the whole index."""
    found = scores(docs, query, fields or {"content": "content"})
    if version and version.strip():
        found = found.filter(F.col("version_bucket") == version.strip())
    return ranked(found, n, id_col=id_col)


def adjusted(rows: DataFrame, query: str, source_col: str = "source_md") -> DataFrame:
    """Scores times the factors of their sources, ranked again; equal scores keep their order."""
    howto = rows.sparkSession.range(1).select(is_howto(F.lit(query))).first()[0]
    source = F.lower(F.col(source_col))
    factor = F.lit(1.0)
    for part, only, x in FACTORS:
        if howto or not only:
            factor = factor * F.when(F.contains(source, F.lit(part)), x).otherwise(1.0)
    if howto:
        factor = factor * F.when(actionable(F.col(source_col)), ACTIONABLE_FACTOR).otherwise(1.0)
    out = rows.withColumn("score", F.col("score") * factor)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank")))


def actionable(source: Column) -> Column:
    return F.lower(source).rlike("|".join(ACTIONABLE))


def postings(docs: DataFrame, fields: dict[str, str], id_col: str = "id") -> DataFrame:
    """The index: field, term, id, tf, length. Written by term it serves any query by a scan of its terms."""
    each = [docs.select(F.lit(f).alias("field"), F.col(id_col).alias("id"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("t")) for f, c in fields.items()]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    return rows.select("field", "id", F.size("t").alias("length"), F.inline(term_counts(F.col("t"))))


def term_counts(words: Column) -> Column:
    """Each different word with how often it occurs: runs of equal words once they are sorted."""

    def runs(s: Column) -> Column:
        new = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return once(new, lambda at: F.zip_with(at, F.slice(F.concat(at, F.array(F.size(s) + 1)), F.lit(2), F.size(at)), lambda a, z: F.struct(F.element_at(s, a).alias("term"), (z - a).cast("long").alias("tf"))))

    return once(F.array_sort(words), lambda s: F.when(F.size(s) > 0, runs(s)))


def term_stats(index: DataFrame) -> DataFrame:
    """field, term, df, occurrences; sums are combined before the shuffle."""
    return index.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def snapshot(docs: DataFrame, fields: dict[str, str], id_col: str = "id") -> str:
    """A key of what is to be indexed: it changes with any row or field."""
    n, h = docs.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join([id_col, *fields.values()])}))")).first()
    return hashlib.sha1(f"{n}|{h}|{sorted(fields.items())}".encode()).hexdigest()


def index(docs: DataFrame, fields: dict[str, str], path: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(postings, statistics by field) below path; built only where this snapshot isn't there yet.

    Each snapshot has a folder of its own and Spark's marker of success, so readers never see half an index.
    """
    spark, base = docs.sparkSession, f"{path}/{snapshot(docs, fields, id_col)}"
    try:
        return spark.read.parquet(f"{base}/postings"), spark.read.parquet(f"{base}/fields")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # Each part is sorted by itself: dealing by ranges of terms would split all texts once more to find the ranges.
    postings(docs, fields, id_col).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{base}/postings")
    n = docs.count()
    found = {r.field: r.words for r in spark.read.parquet(f"{base}/postings").groupBy("field").agg(F.sum("tf").alias("words")).collect()}  # a row for each field
    sizes = [(f, float(n), found.get(f, 0) / n if n else None) for f in fields]
    spark.createDataFrame(sizes, "field string, n double, mean double").coalesce(1).write.mode("overwrite").parquet(f"{base}/fields")
    return spark.read.parquet(f"{base}/postings"), spark.read.parquet(f"{base}/fields")


def scan(found: DataFrame, stats: DataFrame, query: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """id, score by an index: only the query's terms are read, and only their postings are shuffled."""
    boosts = boosts or BOOSTS
    rows = found.filter(F.col("term").isin(query_terms(query)))
    df = rows.groupBy("field", "term").agg(F.count("*").cast("double").alias("df"))
    rows = rows.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")  # a row for each term and field
    boost = F.coalesce(*[F.when(F.col("field") == f, b) for f, b in boosts.items()], F.lit(1.0))
    return rows.groupBy("id").agg(F.sum(boost * idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col("length"), F.col("mean"))).alias("score"))
