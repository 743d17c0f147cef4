"""The queries over the driver's tables, each beside its SQL.

documents stand for chunks (id = doc_id, version_bucket = lang, source_md = source, content = text), embeddings for
vectors (vec_id = doc_id), pages for the crawled site. Counts are long, doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import Settings
from docloom.functions import tokens as tk
from docloom.functions import urls
from docloom.functions.context import compact_column
from docloom.operators import bm25, dense, fusion, quality, rerank
from docloom.plans import search, stages
from docloom.sources import crawl, records, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TERMS, HOWTO, VERSION, TARGET = "the of and", "how to install the ing", "en", 7
BASE = "https://docs.example.com"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks; the heading is the source with the language, the title the first word pair's stand-in."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("lang").alias("version_bucket"), F.col("source").alias("source_md"), F.col("text").alias("content"), F.concat(F.lit("document "), F.col("source"), F.lit(" the")).alias("title"), F.concat_ws(" ", "lang", "source").alias("heading"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("version_bucket")), "id", "left")


def target(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == TARGET).first()["embedding"])


def r6(c: str):
    return F.round(c, 6).alias(c)


CHUNKS = "d AS (SELECT doc_id AS id, lang AS version_bucket, source AS source_md, text AS content, 'document ' || source || ' the' AS title, lang || ' ' || source AS heading FROM documents)"


def tokens_sql(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) < 80)"


def bm25_sql(terms: str, n: int, fields: tuple[str, ...] = ("content",), where: str = "TRUE") -> str:
    """Common tables that end in `bm` (id, score, rank)."""
    words = ", ".join(f"('{t}')" for t in terms.split())
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, {bm25.BOOSTS[f]}::DOUBLE AS boost, id, version_bucket, {tokens_sql(f)} AS t FROM d" for f in fields)
    return f"""{CHUNKS}, q(term) AS (VALUES {words}),
f AS ({each}),
s AS (SELECT field, count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM f GROUP BY field),
tf AS (SELECT field, boost, id, version_bucket, len(t) AS l, term, len(list_filter(t, lambda x: x = term)) AS tf FROM f, q),
df AS (SELECT field, term, count_if(tf > 0)::DOUBLE AS df FROM tf GROUP BY field, term),
sc AS (SELECT id, any_value(version_bucket) AS version_bucket, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score
       FROM tf JOIN df USING (field, term) JOIN s USING (field) WHERE tf > 0 GROUP BY id),
bm AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM sc WHERE {where} QUALIFY rank <= {n})"""


def steady(rows: DataFrame) -> DataFrame:
    """Scores rounded before they are ranked, so that the order of sums doesn't decide ties."""
    return rows.withColumn("score", F.round("score", 9))


def bm25_top(spark: SparkSession, d: str, text: str, n: int, fields: tuple[str, ...] = ("content",), version: str | None = None) -> DataFrame:
    found = steady(bm25.scores(documents(spark, d), text, {f: f for f in fields}))
    return bm25.ranked(found.filter(F.col("version_bucket") == version) if version else found, n)


@query(f"WITH {bm25_sql(TERMS, 20)} SELECT id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return bm25_top(spark, d, TERMS, 20).select("id", r6("score"), "rank")


@query(f"WITH {bm25_sql(TERMS, 20, ('content', 'title', 'heading'))} SELECT id, round(score, 6) AS score, rank FROM bm")
def bm25_multifield(spark, d):
    return bm25_top(spark, d, TERMS, 20, ("content", "title", "heading")).select("id", r6("score"), "rank")


@query(f"WITH {bm25_sql(TERMS, 20, where=f"version_bucket = '{VERSION}'")} SELECT id, round(score, 6) AS score, rank FROM bm")
def bm25_version_filter(spark, d):
    return bm25_top(spark, d, TERMS, 20, version=VERSION).select("id", r6("score"), "rank")


@query(f"WITH {bm25_sql(TERMS, 20)} SELECT id, round(score, 6) AS score, rank FROM bm")
def bm25_index_scan(spark, d):
    folder = crawl.shared_folder(spark)
    found, stats = bm25.index(documents(spark, d), {"content": "content"}, f"{folder}/docloom-index")
    return bm25.ranked(steady(bm25.scan(found, stats, TERMS)), 20).select("id", r6("score"), "rank")


@query(f"""WITH {bm25_sql('how to install the ing', 50)},
a AS (SELECT id, score * CASE WHEN id % 3 = 0 THEN 0.15 WHEN id % 3 = 1 THEN 0.75 ELSE 1.15 END AS score, rank AS old FROM bm)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, old)::INTEGER AS rank FROM a""")
def bm25_adjusted(spark, d):
    rows = bm25_top(spark, d, HOWTO, 50)
    name = F.when(F.col("id") % 3 == 0, "x_changelog_y").when(F.col("id") % 3 == 1, "a__reference__b").otherwise("sdk__tools__c")
    rows = steady(rows.withColumn("source_md", name).withColumn("rank", F.col("rank")))
    return steady(bm25.adjusted(rows, HOWTO)).select("id", r6("score"), "rank")


@query(f"""WITH {CHUNKS}, t AS (SELECT id, unnest({tokens_sql('content')}) AS term FROM d),
p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL)
SELECT 'content' AS field, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term""")
def corpus_stats(spark, d):
    return bm25.term_stats(bm25.postings(documents(spark, d), {"content": "content"}))


DENSE = f"""qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {TARGET}),
v AS (SELECT vec_id AS id, lang AS version_bucket, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS score
      FROM embeddings LEFT JOIN documents ON doc_id = vec_id, qv)"""


def dense_sql(n: int, where: str = "TRUE") -> str:
    return f"{DENSE}, de AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM v WHERE {where} QUALIFY rank <= {n})"


@query(f"WITH {dense_sql(20)} SELECT id, round(score, 6) AS score, rank FROM de")
def dense_topk(spark, d):
    return dense.top(vectors(spark, d), target(spark, d), 20).select("id", r6("score"), "rank")


@query(f"WITH {dense_sql(60, 'score >= 0.2')} SELECT id, round(score, 6) AS score, rank FROM de")
def dense_threshold(spark, d):
    return dense.top(vectors(spark, d), target(spark, d), 60, threshold=0.2).select("id", r6("score"), "rank")


@query(f"WITH {dense_sql(20, f"version_bucket = '{VERSION}'")} SELECT id, round(score, 6) AS score, rank FROM de")
def dense_version_filter(spark, d):
    return dense.top(vectors(spark, d), target(spark, d), 20, version=VERSION).select("id", r6("score"), "rank")


RRF = """f AS (SELECT coalesce(de.id, bm.id) AS id, coalesce(1.0::DOUBLE / (60 + de.rank), 0) + coalesce(0.55::DOUBLE / (60 + bm.rank), 0) AS score, de.rank AS dense_rank, bm.rank AS bm25_rank FROM de FULL JOIN bm ON de.id = bm.id),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 60)"""
RRF = RRF.replace("f AS", "fu AS", 1).replace("FROM f Q", "FROM fu Q")


@query(f"WITH {bm25_sql(TERMS, 300)}, {dense_sql(60)}, {RRF} SELECT id, round(score, 6) AS score, dense_rank, bm25_rank, rank FROM r")
def rrf_fusion(spark, d):
    near = dense.top(vectors(spark, d), target(spark, d), 60)
    return fusion.rrf(near, bm25_top(spark, d, TERMS, 300), 60).select("id", r6("score"), "dense_rank", "bm25_rank", "rank")


@query()
def hybrid_search(spark, d):
    near = vectors(spark, d)
    rows, _ = search.search(documents(spark, d), near, TERMS, lambda _: target(spark, d), Settings(retrieval_mode="hybrid"))
    return rows.select("id", r6("score"), "rank", "title", "version_bucket", "source_md", "heading", "content")


SQL["hybrid_search"] = f"""WITH {bm25_sql('the of and', 300, ('content', 'title', 'heading'))}, {dense_sql(60)},
dj AS (SELECT de.* FROM de JOIN d ON d.id = de.id),
{RRF.replace('de.', 'dj.').replace('FROM de FULL', 'FROM dj FULL')}
SELECT r.id, round(r.score, 6) AS score, r.rank, title, version_bucket, source_md, heading,
       CASE WHEN length(content) > 280 THEN substr(content, 1, 277) || '...' ELSE content END AS content
FROM r JOIN d ON d.id = r.id WHERE r.rank <= 10"""


@query(f"""WITH {CHUNKS} SELECT id, 'Title: ' || title || chr(10) || 'Version: ' || version_bucket || chr(10) || 'Heading: ' || heading || chr(10) || trim(content) AS document FROM d WHERE trim(content) <> ''""")
def rerank_documents(spark, d):
    doc = rerank.document(F.col("title"), F.col("version_bucket"), F.col("heading"), F.col("content"))
    return documents(spark, d).select("id", doc.alias("document")).filter("document is not null")


@query("""SELECT conv_id, (turn % 3)::BIGINT AS idx, max((conv_id * 7 + turn * 13) % 101 / 100.0::DOUBLE) AS rerank_score FROM conversations WHERE turn % 5 <> 4 GROUP BY ALL""")
def rerank_parse(spark, d):
    c = table(spark, d, "conversations")
    score = (F.col("conv_id") * 7 + F.col("turn") * 13) % 101 / 100.0
    one = F.struct((F.col("turn") % 3).alias("index"), F.when(F.col("turn") % 5 != 4, score).alias("score"))
    answers = c.select("conv_id", F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return rerank.parse_scores(answers, by=("conv_id",))


@query(f"""WITH {bm25_sql(TERMS, 30)}, rs AS (SELECT *, CASE WHEN id % 3 = 0 THEN id % 17 / 17.0::DOUBLE END AS rerank_score FROM bm)
SELECT id, rank, round(rerank_score, 6) AS rerank_score, row_number() OVER (ORDER BY rerank_score DESC NULLS LAST, rank)::INTEGER AS final_rank FROM rs""")
def rerank_order(spark, d):
    rows = bm25.held(bm25_top(spark, d, TERMS, 30).select("id", "rank"))
    scores = rows.filter("id % 3 = 0").select((F.col("rank") - 1).alias("idx"), (F.col("id") % 17 / 17.0).alias("rerank_score"))
    return rerank.apply(rows, scores).select("id", "rank", r6("rerank_score"), "final_rank")


def concept_sql(x: str) -> str:
    lines = []
    for name, inside, begins, equal in tk.CONCEPTS:
        fits = [f"contains({x}, '{v}')" for v in inside] + [f"starts_with({x}, '{v}')" for v in begins] + [f"{x} = '{v}'" for v in equal]
        lines.append(f"WHEN {' OR '.join(fits)} THEN '{name}'")
    stop = ", ".join(f"'{s}'" for s in tk.STOP_WORDS)
    return f"CASE {' '.join(lines)} WHEN {x} IN ({stop}) OR length({x}) < 3 THEN NULL ELSE {x} END"


def canonical_sql(text: str) -> str:
    found = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
    return f"list_filter(list_transform({found}, lambda x: {concept_sql('x')}), lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, len(list_distinct(t))::BIGINT AS n, t[1] AS first, list_aggregate(list_sort(list_distinct(t)), 'string_agg', ' ') AS tokens FROM (SELECT doc_id, {canonical_sql('text')} AS t FROM documents)")
def canonical_tokens(spark, d):
    c = F.col("c")
    out = table(spark, d, "documents").select("doc_id", tk.canonical(F.col("text")).alias("c"))
    return out.select("doc_id", F.size(c).cast("long").alias("n"), F.try_element_at(c, F.lit(1)).alias("first"), F.nullif(F.array_join(F.array_sort(c), " "), F.lit("")).alias("tokens"))


@query(f"SELECT doc_id, round(len(list_intersect(['install', 'package', 'and', 'that'], {canonical_sql('text')})) / 4.0::DOUBLE, 6) AS coverage FROM documents".replace("'package'", "'rpm'"))
def token_coverage(spark, d):
    q = tk.canonical(F.lit("install package and that"))
    return table(spark, d, "documents").select("doc_id", F.round(tk.coverage(q, tk.canonical(F.col("text"))), 6).alias("coverage"))


def _q(conv: str) -> str:
    return f"CASE {conv} % 4 WHEN 0 THEN 'install rpm package' WHEN 1 THEN 'how to build' WHEN 2 THEN 'launch the emulator' ELSE 'plain words' END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_q('conv_id')} AS q FROM conversations)
SELECT conv_id, turn, CASE q WHEN 'install rpm package' THEN 'install rpm package рпм установка установить' WHEN 'how to build' THEN 'how to build сборка собрать'
  WHEN 'launch the emulator' THEN 'launch the emulator эмулятор запуск' ELSE q END AS expanded, q <> 'plain words' AS howto FROM c""")
def query_expansion(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_q("conv_id")).alias("q"))
    return c.select("conv_id", "turn", tk.expand(F.col("q")).alias("expanded"), tk.is_howto(F.col("q")).alias("howto"))


@query(r"""SELECT doc_id, translate(text, ':()[]{}"\^~*?!+-', '                ') AS cleaned FROM documents""")
def query_sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", tk.sanitize_query(F.col("text")).alias("cleaned"))


QUALITY = f"""{bm25_sql(TERMS, 10)},
p AS (SELECT bm.rank, title || ' ' || source_md || ' ' || content AS h, source_md FROM bm JOIN d USING (id) WHERE rank <= 5),
m AS (SELECT len(list_intersect(['and'], {canonical_sql('h')}))::DOUBLE AS c FROM p),
a AS (SELECT count(*)::BIGINT AS n, coalesce(max(c), 0) AS coverage, TRUE AS supported, 0::BIGINT AS actionable FROM m),
g AS (SELECT *, CASE WHEN n = 0 THEN 'low' WHEN coverage < 0.58 THEN 'low' ELSE 'medium' END AS confidence FROM a)"""


@query(f"WITH {QUALITY} SELECT * FROM g")
def answer_quality(spark, d):
    rows = bm25_top(spark, d, TERMS, 10)
    return quality.answer_quality(rows, TERMS)


#: Query, its concepts, the action it needs.
CASES = (("install the rpm package", ("install", "rpm"), "install"), ("launch and that", ("launch", "and", "that"), "launch"), ("and that", ("and", "that"), None), ("the", (), None))


def _cases_sql() -> str:
    out = []
    for q, concepts, action in CASES:
        own = f"[{', '.join(repr(c) for c in concepts)}]::VARCHAR[]"
        fits = f"list_contains(t, '{action}')" if action else "TRUE"
        share = f"len(list_intersect({own}, t)) / {len(concepts)}.0::DOUBLE" if concepts else "0.0::DOUBLE"
        out.append(f"SELECT '{q}' AS q, {len(concepts)} AS k, {share} AS c, {fits} AS a, s LIKE 'sdk__tools%' AS act FROM p")
    return " UNION ALL ".join(out)


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sdk__tools__x' ELSE 'other' END AS s, CASE WHEN doc_id % 3 = 0 THEN 'install rpm' ELSE 'launch' END AS title, text FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 5),
p AS (SELECT s, {canonical_sql("title || ' ' || s || ' ' || text")} AS t FROM b), m AS ({_cases_sql()}),
g AS (SELECT q, any_value(k) AS k, count(*)::BIGINT AS n, max(c) AS coverage, bool_or(a) AS supported, count_if(act)::BIGINT AS actionable FROM m GROUP BY q)
SELECT q, n, round(coverage, 6) AS coverage, supported, actionable,
  CASE WHEN k = 0 THEN 'medium' WHEN NOT supported THEN 'low' WHEN coverage < 0.58 THEN 'low' WHEN coverage >= 0.9 AND actionable >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM g""")
def answer_quality_cases(spark, d):
    """Queries that need an action, that need none and that have no concept, on five documents of which some are actionable."""
    first = table(spark, d, "documents").filter("text is not null").orderBy("doc_id").limit(5)
    rows = first.select(F.col("doc_id").alias("rank"), F.when(F.col("doc_id") % 2 == 0, "sdk__tools__x").otherwise("other").alias("source_md"), F.when(F.col("doc_id") % 3 == 0, "install rpm").otherwise("launch").alias("title"), F.col("text").alias("content"))
    rows = bm25.held(rows)
    each = [quality.answer_quality(rows, q).select(F.lit(q).alias("q"), "n", r6("coverage"), "supported", "actionable", "confidence") for q, _, _ in CASES]
    return reduce(DataFrame.unionByName, each)


@query(f"WITH {QUALITY} SELECT bm.id, bm.rank FROM bm, g WHERE confidence <> 'low'")
def knowledge_gate(spark, d):
    rows = bm25.held(bm25_top(spark, d, TERMS, 10))
    return quality.gate(rows, quality.answer_quality(rows, TERMS).first()["confidence"], "medium").select("id", "rank")


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 277) || '...' ELSE text END AS short, CASE WHEN length(text) > 60 THEN '...' || right(text, 57) ELSE text END AS tail FROM documents")
def shorten(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tk.shorten(t, 280).alias("short"), tk.shorten_front(t, 60).alias("tail"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS context FROM documents""")
def context_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", compact_column(F.col("text")).alias("context"))


URL = """p AS (SELECT page_id, url, lower(regexp_extract(url, '^(?:https?)://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme,
  CASE WHEN regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END AS path,
  regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages)""".replace("\\\\", "\\")


@query(f"WITH {URL} SELECT page_id, scheme || '://' || host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url FROM p")
def url_canonicalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("url"))


@query(f"WITH {URL} SELECT page_id, host = 'blog.tiontion.example.com' AND (path = '/en' OR starts_with(path, '/en/')) AS inside, path = '/en' OR starts_with(path, '/en/') AS english FROM p")
def url_scope(spark, d):
    u = F.col("url")
    p = urls.path(u)
    return table(spark, d, "pages").select("page_id", urls.in_scope(u, "blog.tiontion.example.com", "/en").alias("inside"), ((p == "/en") | F.startswith(p, F.lit("/en/"))).alias("english"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE (page_id % 7)::VARCHAR || '.' || (page_id % 5)::VARCHAR END AS version, page_id % 3 <> 0 AS versioned FROM pages""")
def version_segment(spark, d):
    made = F.expr("case when page_id % 3 = 0 then '/doc/sdk/tools' else concat('/doc/', page_id % 7, '.', page_id % 5, '/sdk') end")
    rows = table(spark, d, "pages").select("page_id", urls.version_of(made).alias("version"))
    return rows.withColumn("versioned", F.coalesce(urls.is_version(F.col("version")), F.lit(False)))


SEGMENTS = r"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[^A-Za-z0-9._-]', '_', 'g'))"


@query(f"""WITH {URL} SELECT page_id, array_to_string(list_concat(CASE WHEN len({SEGMENTS}) = 0 THEN ['root'] ELSE {SEGMENTS} END,
  CASE WHEN query = '' THEN [] ELSE ['__q_' || substr(sha1(query), 1, 10)] END, ['index.html']), '/') AS path FROM p""")
def file_path(spark, d):
    return table(spark, d, "pages").select("page_id", urls.html_file_path(F.col("url")).alias("path"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS segment, substr(sha1(url), 1, 10) AS hash FROM pages")
def sanitize_segment(spark, d):
    return table(spark, d, "pages").select("page_id", urls.sanitize(F.col("url")).alias("segment"), urls.short_hash(F.col("url")).alias("hash"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'default' ELSE '5.2.' || page_id END AS bucket, 'a____b__c' || page_id || '.md' AS file_name, 'a__b|c' || page_id AS decoded FROM pages""")
def flat_encode_decode(spark, d):
    rel = F.expr("concat('doc/', case when page_id % 2 = 0 then '' else concat('5.2.', page_id, '/') end, 'a__b/c', page_id, '/index.html')")
    rows = table(spark, d, "pages").select("page_id", urls.output_of(rel).alias("o")).select("page_id", "o.*")
    return rows.withColumn("decoded", F.array_join(urls.flat_decode(F.regexp_replace("file_name", r"\.md$", "")), "|"))


@query(f"""SELECT page_id, '{BASE}/doc' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/5.2' ELSE '' END || CASE page_id % 3 WHEN 2 THEN '' ELSE '/sdk/x' || page_id END AS url,
  '{BASE}/doc' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/5.2' ELSE '' END || CASE page_id % 3 WHEN 2 THEN '' ELSE '/sdk/x' || page_id END || '#top' AS anchored FROM pages""")
def source_url(spark, d):
    bucket, name = F.expr("case page_id % 3 when 1 then '5.2' else 'default' end"), F.expr("case page_id % 3 when 2 then 'index.md' else concat('sdk__x', page_id, '.md') end")
    u = urls.source_url(BASE, bucket, name)
    return table(spark, d, "pages").select("page_id", u.alias("url"), urls.with_anchor(u, F.lit(" top ")).alias("anchored"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1))) AS link FROM pages""".replace("\\\\", "\\"))
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(crawl.native_links(F.col("html"))).alias("link"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages),
e AS (SELECT url AS a, link AS b FROM l UNION SELECT link, url FROM l),
w AS (SELECT (SELECT url FROM pages ORDER BY page_id LIMIT 1) AS n, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.n WHERE w.depth < 10)
SELECT n AS url, min(depth)::BIGINT AS depth FROM w GROUP BY n""".replace("\\\\", "\\"))
def link_graph_bfs(spark, d):
    """Pages and what they link to, both ways: how far all is from the first page."""
    pages = table(spark, d, "pages")
    out = pages.select("url", F.explode(crawl.native_links(F.col("html"))).alias("link"))
    edges = crawl.materialise(out.unionByName(out.select(F.col("link").alias("url"), F.col("url").alias("link"))).distinct())
    return crawl.breadth_first(edges, pages.orderBy("page_id").limit(1))


@query()
def crawl_site(spark, d):
    pages = table(spark, d, "pages")
    first = pages.orderBy("page_id").first()["url"]
    target_host = first.split("/")[2]
    return crawl.crawl(spark, first, crawl.page_fetcher(pages), lambda u: urls.in_scope(u, target_host, "/")).select("url", "depth", "status")


@query("SELECT DISTINCT regexp_extract(link, '^/([0-9]+([.][0-9]+)+)$', 1) AS version FROM (SELECT '/' || (page_id % 4) || '.' || (page_id % 3) AS link FROM pages)")
def version_discovery(spark, d):
    link = F.expr("""concat('<a href="/doc/', page_id % 4, '.', page_id % 3, '/x">v</a>')""")
    return crawl.versions(table(spark, d, "pages").select("url", link.alias("html")), "docs.example.com")


@query()
def page_to_markdown(spark, d):
    return stages.struct_pages(table(spark, d, "pages"))


@query("SELECT count(*)::BIGINT AS total_inputs, count_if(page_id % 4 <> 0)::BIGINT AS converted_total, count_if(page_id % 4 = 0)::BIGINT AS errors_total FROM pages")
def manifest_totals(spark, d):
    """Every fourth page is blank, which is an error of its row."""
    rows = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.col("html")).alias("html"))
    return stages.struct_totals(stages.struct_pages(rows)).drop("chars_total")


@query("""SELECT o_orderkey AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN '## Order ' || o_orderkey || ' {#o' || o_orderkey || '}' || chr(10) || chr(10) || 'by **' || o_custkey || '** [x](/c/' || o_custkey || ')'
    || chr(10) || chr(10) || '* ' || o_orderstatus || chr(10) || '  1. ' || o_orderpriority || chr(10) || chr(10) || chr(10)
    || '```rust' || chr(10) || 'let x = ' || o_custkey || ';' || chr(10) || '```' || chr(10) || chr(10) || '| A | B |' || chr(10) || '| :-- | --: |' || chr(10) || '| ' || o_orderkey || ' | a\\|b |'
    || chr(10) || chr(10) || 'Term {#t' || o_orderkey || '}' || chr(10) || ': Meaning' || chr(10) || chr(10) || '> said `it`' || chr(10) || chr(10) || '---' || chr(10) END AS md,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no content' END AS error FROM orders""".replace("\\\\", "\\"))
def html_blocks(spark, d):
    """Each kind of block from made pages, whose Markdown SQL can spell out."""
    o = stages.dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 10_000)
    html = F.format_string(
        '<html><body><nav>no</nav><article><div class="prose x"><h2><span id="o%1$d" style="Position: absolute;"></span>Order  %1$d</h2><p>by <b>%2$d</b>\n<a href="/c/%2$d">x</a>'
        "<ul><li>%3$s<ol><li> %4$s </ol></ul><pre><code class='language-rust'>let x = %2$d;\n</code></pre><table><tr><th align=left>A<th style='text-align: right'>B<tr><td>%1$d<td>a|b</table>"
        '<dl><dt id="t%1$d">Term<dd>Meaning</dl><blockquote><p>said <code>it</code></p></blockquote><hr></div></article></body></html>',
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
    )
    rows = o.select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 5 == 0, "<html><body> <div><p> </p></div></body></html>").otherwise(html).alias("html"))
    return stages.struct_pages(rows).select("url", "status", "md", "error")


def markdown(spark, d) -> DataFrame:
    """Documents as Markdown: a heading, and one more before every tenth line."""
    t = table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 10 == 5, F.concat(F.lit("## Part "), i.cast("string"), F.lit(" {#p"), i.cast("string"), F.lit("}\n\n"), x)).otherwise(x))
    return t.select(F.when(F.col("lang") == "en", "default").otherwise(F.concat(F.lit("1."), F.length("lang").cast("string"))).alias("version_bucket"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_key"), F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(lines, "\n")).alias("text"))


@query()
def chunk_documents(spark, d):
    return stages.chunk(markdown(spark, d))


#: Markdown of a customer: sentences of 100 characters, and items, code lines and table rows of 60 with their line end.
PARTS = {
    "sentences": "repeat(lpad(c_custkey::VARCHAR, 9, '0') || ' ' || repeat('word ', 17) || 'end. ', 30)",
    "item": "'* ' || lpad(i::VARCHAR, 2, '0') || ' ' || lpad(c_custkey::VARCHAR, 9, '0') || ' ' || repeat('x', 45)",
    "code": "lpad(i::VARCHAR, 2, '0') || ' ' || lpad(c_custkey::VARCHAR, 9, '0') || ' ' || repeat('y', 46)",
    "cell": "lpad(i::VARCHAR, 2, '0') || ' ' || lpad(c_custkey::VARCHAR, 9, '0') || ' ' || repeat('c', 87)",
    "row": "'| ' || lpad(i::VARCHAR, 2, '0') || ' | ' || lpad(c_custkey::VARCHAR, 9, '0') || repeat('z', 41) || ' |'",
}


def _run_sql(part: str, begin: int, end: int, joint: str) -> str:
    return f"array_to_string(list_transform(range({begin}, {end}), lambda i: {PARTS[part]}), {joint})"


def _kinds_sql() -> str:
    """Rows (k, chunk_index, content, heading, section_anchor, source_title, which kind) of each customer's fourteen chunks."""
    line, blank = "chr(10)", "chr(10) || chr(10)"
    top = "'Customer ' || c_custkey"
    t = PARTS["sentences"]
    # A sentence ends at 99, 199, ...; the last within 1320 is the cut, and what follows begins 120 before it.
    content = [f"'# ' || {top} || ' {{#c' || c_custkey || '}}' || {blank} || substr({t}, 1, 1299)", f"trim(substr({t}, 1180, 1320))", f"trim(substr({t}, 2380)) || {blank} || '## List {{#l}}'"]
    # Nineteen items, lines or rows fit; a heading too short for a chunk stays with the chunk before it.
    content += [_run_sql("item", 0, 19, blank), _run_sql("item", 19, 38, blank), f"{_run_sql('item', 38, 40, blank)} || {blank} || '## Code'"]
    content += [f"'```rust' || {line} || {_run_sql('code', a, z, line)} || {line} || '```'" for a, z in ((0, 19), (19, 38), (38, 50))]
    content[-1] += f" || {blank} || '### Rows {{#r}} ###'"
    head = f"'| A | B |' || {line} || '| --- | --- |' || {line}"
    content += [f"{head} || {_run_sql('row', a, z, line)}" for a, z in ((0, 19), (19, 38))]
    # A cell too long for a row: eleven of its parts of 100 fit with their <br/>, and each piece keeps the other cells.
    content += [f"{head} || '| key  of ' || c_custkey || ' (cont. {n}/2) | ' || array_to_string(list_transform(range({a}, {z}), lambda i: {PARTS['cell']}), '<br/>') || ' |'" for n, a, z in ((1, 0, 11), (2, 11, 17))]
    content += [f"{head} || {_run_sql('row', 38, 45, line)}"]
    content[-1] += f" || {blank} || '# Short' || {blank} || 'brief'"
    content = [c.replace("{{", "{").replace("}}", "}") for c in content]
    below = [(top, "'c' || c_custkey", top, "text"), (f"{top} || ' > List'", "'l'", "'List'", "list"), (f"{top} || ' > Code'", "NULL", "'Code'", "code"), (f"{top} || ' > Code > Rows'", "'r'", "'Rows'", "table")]
    rows = [f"SELECT c_custkey, {n}::BIGINT AS chunk_index, {c} AS content, {below[min(n // 3, 3)][0]} AS heading, {below[min(n // 3, 3)][1]} AS section_anchor, {below[min(n // 3, 3)][2]} AS source_title, '{below[min(n // 3, 3)][3]}' AS kind FROM customer" for n, c in enumerate(content)]
    return " UNION ALL ".join(rows)


@query(f"""WITH c AS ({_kinds_sql()}), h AS (SELECT *, c_custkey || '.md' AS doc_key, 'default/' || c_custkey || '.md' AS source_md, sha1(content) AS content_hash,
  CASE chunk_index WHEN 11 THEN 0 WHEN 12 THEN 1 END AS part FROM c)
SELECT doc_key, chunk_index, 14::BIGINT AS chunk_count_in_doc, content, heading, section_anchor, source_title, kind = 'code' AS has_code, kind = 'table' AS has_table, kind = 'list' AS has_list,
  CASE WHEN part >= 0 THEN sha1(source_md || '|' || heading || '|r|table#0') END AS table_id, CASE WHEN part >= 0 THEN 0::BIGINT END AS table_ordinal, CASE WHEN part >= 0 THEN 'A,B' END AS headers,
  CASE WHEN part >= 0 THEN 38::BIGINT END AS row_ordinal, CASE WHEN part >= 0 THEN 'key of ' || c_custkey END AS row_key, CASE WHEN part >= 0 THEN 1::BIGINT END AS cell_ordinal, part::BIGINT AS cell_part_index,
  CASE WHEN part >= 0 THEN 2::BIGINT END AS cell_part_total, part IS NOT NULL AS is_table_continuation,
  length(content)::BIGINT AS char_count, content_hash, sha1('default|' || source_md || '|' || chunk_index || '|' || content_hash) AS id,
  '{BASE}/doc/' || c_custkey || coalesce('#' || section_anchor, '') AS link FROM h""")
def chunk_kinds(spark, d):
    """Sections, packing, splits of text, lists, code and tables, and merging of short chunks, on Markdown made of customers."""
    made = {p: sql.replace("::VARCHAR", "::string") for p, sql in PARTS.items()}
    run = lambda p, a, z, joint="\\n": f"array_join(transform(sequence({a}, {z - 1}), i -> {made[p]}), '{joint}')"
    text = F.expr(
        f"concat('# Customer ', c_custkey, ' {{#c', c_custkey, '}}\\n\\n', {made['sentences']}, '\\n\\n## List {{#l}}\\n\\n', {run('item', 0, 40)}, '\\n\\n## Code\\n```rust\\n', {run('code', 0, 50)},"
        f" '\\n```\\n\\n### Rows {{#r}} ###\\n| A | B |\\n| --- | --- |\\n', {run('row', 0, 38)}, '\\n| key  of ', c_custkey, ' | ', {run('cell', 0, 17, '<br/>')}, ' |\\n', {run('row', 38, 45)}, '\\n# Short\\n\\n\\nbrief\\n')"
    )
    customers = stages.dealt(table(spark, d, "customer").select("c_custkey"), 2_000)
    docs = customers.select(F.lit("default").alias("version_bucket"), F.concat(F.col("c_custkey").cast("string"), F.lit(".md")).alias("doc_key"), text.alias("text"))
    rows = stages.chunk(docs)
    return rows.select("doc_key", "chunk_index", "chunk_count_in_doc", "content", F.array_join("heading_path", " > ").alias("heading"), "section_anchor", "source_title", *stages.SUMMARY, "table_id", "table_ordinal", F.array_join("column_headers", ",").alias("headers"), "row_ordinal", "row_key", "cell_ordinal", "cell_part_index", "cell_part_total", "is_table_continuation", "char_count", "content_hash", "id", F.col("source_url_with_anchor").alias("link"))


@query()
def chunk_stats_by_bucket(spark, d):
    return stages.chunk_stats(stages.chunk(markdown(spark, d)))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, line, sum(CASE WHEN n % 10 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*)::BIGINT AS lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL""")
def heading_sections(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    running = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.sum((F.col("n") % 10 == 0).cast("long")).over(running))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).cast("long").alias("chars"))


@query("SELECT doc_id, sha1(text) AS content_hash, sha1(lang || '|' || source || '|0|' || sha1(text)) AS id FROM documents")
def chunk_keys(spark, d):
    digest = stages.content_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", digest.alias("content_hash"), stages.chunk_id(F.col("lang"), F.col("source"), F.lit(0), digest).alias("id"))


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT)::VARCHAR AS point_id FROM documents")
def point_id(spark, d):
    return table(spark, d, "documents").select("doc_id", stages.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def resume_anti_join(spark, d):
    done = table(spark, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return stages.pending(table(spark, d, "documents").select(F.col("doc_id").alias("id")), done)


@query("SELECT count(*)::BIGINT AS vectors, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings")
def dim_check(spark, d):
    return stages.dim_check(table(spark, d, "embeddings"), "embedding")


@query("SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def upsert_dedup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("total"))
    return sinks.upsert(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS note FROM events WHERE event_id % 5 <> 0 AND trim(json_extract_string(props, '$.k')) <> ''""")
def permissive_records(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "[broken").otherwise(F.col("props")).alias("json"))
    return records.permissive(rows, "json", records.T.StructType().add("k", "string").add("note", "string"), key="k")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN event_id + 1 END AS total FROM events""")
def manifest_fallback(spark, d):
    e = table(spark, d, "events")
    m = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").alias("vectors_total")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct((F.col("event_id") + 1).alias("chunks_embedded")))).otherwise("{}")
    return records.vectors_total(e.select("event_id", m.alias("json")), keep=("event_id",))


@query("SELECT doc_id, doc_id % 1000 AS shard, CASE WHEN doc_id % 2 = 0 THEN 'a/' || doc_id ELSE '/b/' || doc_id END AS path, doc_id % 2 = 0 AS safe FROM documents")
def shard_paths(spark, d):
    p = F.expr("case when doc_id % 2 = 0 then concat('a/', doc_id) else concat('/b/', doc_id) end")
    name = F.concat(F.lit("x/chunks-"), F.lpad((F.col("doc_id") % 1000).cast("string"), 5, "0"), F.lit(".jsonl"))
    return table(spark, d, "documents").select("doc_id", urls.shard_index(name, "chunks-").alias("shard"), p.alias("path"), urls.safe_relative(p).alias("safe"))


@query()
def embed_documents(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return stages.embed(rows, dense.hashing_embedder(16), "hashing").select("id", "embedding_dim", "point_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def rerank_scored(spark, d):
    rows = bm25.held(bm25_top(spark, d, TERMS, 30))
    return rerank.rerank(rows, TERMS, rerank.overlap_scorer).select("id", "rank", "rerank_score", "final_rank")
