"""Crawling as rounds of joins: a frontier is fetched, its links that weren't seen are the next frontier.

A fetcher is any function from addresses to pages, so a crawl of the network and a walk over pages already fetched are
the same plan. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.functions.html_md import page_links

DEPTH = 10


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session within one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again; the files go when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/docloom-crawl-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(pages: DataFrame) -> DataFrame:
    """url, link: the canonical addresses that each page links to, each once."""
    found = pages.select("url", F.explode(page_links(F.col("html"), F.col("url"))).alias("link"))
    return found.select("url", urls.canonicalize(F.col("link")).alias("link")).filter("link is not null").distinct()


def native_links(html: Column) -> Column:
    """The href values of <a> tags by regular expression: for pages with quoted attributes."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1)))


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """url, depth: how many links of edges(url, link) lie between the seeds and each address, `depth` at most."""
    frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0).cast("long"))
    seen = materialise(frontier)
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        frontier = materialise(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def crawl(spark: SparkSession, seed: str, fetch: Callable[[DataFrame], DataFrame], scope: Callable[[Column], Column], depth: int = DEPTH) -> DataFrame:
    """url, depth, status, html, error, final_url of all pages in scope. fetch: rows(url) to rows(url, html, error), with
    final, the address after redirects, if it knows that; errors are rows too. A page that was redirected out of scope is an
    error, its links count from where it ended, and that address isn't fetched again."""
    start = spark.createDataFrame([(seed,)], "url string").select(urls.canonicalize(F.col("url")).alias("url"))
    seen = known = None
    for d in range(depth + 1):
        got = fetch(start.filter(scope(F.col("url"))))
        final = urls.canonicalize(F.coalesce("final", "url")) if "final" in got.columns else F.col("url")
        got = got.withColumn("final_url", final)
        away = F.when(F.col("final_url").isNull(), "invalid redirect target URL").when(~scope(F.col("final_url")), F.concat(F.lit("redirected out of scope: "), F.col("final_url")))
        got = got.withColumn("error", F.coalesce("error", away)).withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
        page = materialise(got.select("url", F.lit(d).cast("long").alias("depth"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "html", "error", "final_url"))
        seen = page if seen is None else seen.unionByName(page)
        both = page.select("url").unionByName(page.filter("status = 'ok'").select(F.col("final_url").alias("url")))
        known = both if known is None else known.unionByName(both)
        ends = page.filter("status = 'ok'").select(F.col("final_url").alias("url"), "html")
        next_ = links(ends).filter(scope(F.col("link"))).select(F.col("link").alias("url")).distinct()
        start = materialise(next_.join(known, "url", "left_anti"))
        if start.isEmpty():
            break
    return seen


def totals(records: DataFrame) -> DataFrame:
    """One row about a crawl: visited_total, saved_total, errors_total."""
    return records.agg(F.count_distinct("url").alias("visited_total"), F.count_if(F.col("status") == "ok").alias("saved_total"), F.count_if(F.col("status") == "error").alias("errors_total"))


def page_fetcher(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over pages(url, html) that are there already."""
    known = pages.select(urls.canonicalize(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    return lambda wanted: wanted.join(known, "url", "left").select("url", "html", F.when(F.col("html").isNull(), "not found").alias("error"))


def versions(pages: DataFrame, target: str) -> DataFrame:
    """The versions that pages name, in their embedded JSON or in their links, each once and sorted."""
    data = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    named = F.from_json(F.get_json_object(data, "$.props.pageProps.initialState.version.availableVersions"), "array<string>")
    linked = pages.select(F.explode(native_links(F.col("html"))).alias("v"))
    path = F.when(F.startswith("v", F.lit("/")), urls.normalize_path(F.col("v"))).when(urls.host(F.col("v")) == target, urls.path(F.col("v")))
    found = pages.select(F.explode(named).alias("version")).unionByName(linked.select(urls.version_of(path).alias("version")))
    return found.filter(urls.is_version(F.col("version"))).distinct().orderBy("version")


@dataclass(frozen=True)
class HttpClient:
    """How pages are asked for."""

    agent: str = "docloom/1.0"
    accept: str = "text/html,application/xhtml+xml"
    language: str = "ru,en;q=0.8"
    timeout: float = 30.0
    redirects: int = 10

    def get(self, url: str) -> tuple[str | None, str | None, str]:
        """(html, error, address after redirects); html or error is null."""
        from urllib.request import HTTPRedirectHandler, Request, build_opener

        handler = HTTPRedirectHandler()
        handler.max_redirections = self.redirects
        asked = Request(url, headers={"User-Agent": self.agent, "Accept": self.accept, "Accept-Language": self.language})
        try:
            with build_opener(handler).open(asked, timeout=self.timeout) as got:
                return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace"), None, got.geturl()
        except Exception as e:  # a page that can't be had is a row, not the end of a crawl
            return None, str(e)[:500], url


def http_fetcher(client: HttpClient | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over the network, spread over the executors."""
    client = client or HttpClient()

    def fetch(batches):
        for batch in batches:
            got = [client.get(u) for u in batch["url"]]
            yield pd.DataFrame({"url": batch["url"], "html": [x[0] for x in got], "error": [x[1] for x in got], "final": [x[2] for x in got]})

    return lambda wanted: wanted.mapInPandas(fetch, "url string, html string, error string, final string")
