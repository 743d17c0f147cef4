"""Address and path functions as native column expressions; null where an input is null or doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP = r"^(?i:(https?))://([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, HTTP, k)


def canonicalize(url: Column) -> Column:
    """http(s) only: lower-case scheme and host, no fragment, empty query, default port or trailing slash."""
    url = F.trim(url)
    scheme, host, port, path, query = F.lower(_part(url, 1)), F.lower(_part(url, 2)), _part(url, 3), normalize_path(_part(url, 4)), _part(url, 5)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    made = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(HTTP), made)


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return normalize_path(_part(url, 4))


def query_of(url: Column) -> Column:
    return _part(url, 5)


def normalize_path(p: Column) -> Column:
    cut = F.regexp_replace(p, "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def in_scope(url: Column, target: str, prefix: str) -> Column:
    p = path(url)
    return (host(url) == target.lower()) & ((p == prefix) | F.startswith(p, F.lit(prefix.rstrip("/") + "/")))


def version_of(p: Column, root: str = "doc") -> Column:
    """The version directory below /root/, null if there is none."""
    found = F.regexp_extract(p, rf"^/{root}/([0-9]+(?:\.[0-9]+)+)(?:/|$)", 1)
    return F.when(found != "", found)


def is_version(segment: Column) -> Column:
    return segment.rlike(r"^[0-9]+(\.[0-9]+)+$")


def matches_scope(url: Column, target: str, prefix: str, version: str | None) -> Column:
    """In scope, and of that version; without a version, of none."""
    v = version_of(path(url))
    return in_scope(url, target, prefix) & (v.isNull() if version is None else v.eqNullSafe(F.lit(version)))


def sanitize(segment: Column) -> Column:
    made = F.regexp_replace(segment, "[^A-Za-z0-9._-]", "_")
    return F.when(made == "", "_").otherwise(made)


def short_hash(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 10)


def html_file_path(url: Column) -> Column:
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), sanitize)
    q = query_of(url)
    folder = F.when(F.size(segments) == 0, F.array(F.lit("root"))).otherwise(segments)
    extra = F.when(q == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("__q_"), short_hash(q))))
    return F.array_join(F.concat(folder, extra, F.array(F.lit("index.html"))), "/")


def relative_path(p: Column, root: str) -> Column:
    p = F.replace(p, F.lit("\\"), F.lit("/"))
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(inside)), F.substr(p, F.lit(len(inside) + 1))).otherwise(p)


def flat_segment(segment: Column) -> Column:
    return sanitize(F.replace(segment, F.lit("__"), F.lit("____")))


def flat_name(segments: Column) -> Column:
    """Segments as one file name; no segment is the index."""
    return F.concat(F.when(F.size(segments) == 0, "index").otherwise(F.array_join(F.transform(segments, flat_segment), "__")), F.lit(".md"))


def flat_decode(name: Column) -> Column:
    """The inverse: from the left, four underscores are two, two part segments."""
    marked = F.replace(F.replace(name, F.lit("____"), F.lit("\u0001")), F.lit("__"), F.lit("\u0002"))
    return F.transform(F.split(marked, "\u0002"), lambda s: F.replace(s, F.lit("\u0001"), F.lit("__")))


def output_of(rel: Column) -> Column:
    """struct(bucket, file_name) of doc/[version/]a/b/index.html; null for other shapes."""
    parts = F.split(rel, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    first = F.try_element_at(inner, F.lit(1))
    versioned = F.coalesce(is_version(first), F.lit(False))
    rest = F.when(versioned, F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0)))).otherwise(inner)
    fits = (F.element_at(parts, 1) == "doc") & (F.element_at(parts, -1) == "index.html") & (F.size(parts) > 1)
    return F.when(fits, F.struct(F.when(versioned, first).otherwise("default").alias("bucket"), flat_name(rest).alias("file_name")))


def source_url(base: str, bucket: Column, name: Column) -> Column:
    """base/doc[/bucket][/segments] of a .md file name; null for other names."""
    stem = F.regexp_extract(name, r"^(.*)\.md$", 1)
    segments = F.when(stem == "index", F.array().cast("array<string>")).otherwise(flat_decode(stem))
    head = F.when(bucket == "default", F.array(F.lit(base), F.lit("doc"))).otherwise(F.array(F.lit(base), F.lit("doc"), bucket))
    return F.when(name.rlike(r"(?s)^.+\.md$"), F.array_join(F.concat(head, segments), "/"))


def with_anchor(url: Column, anchor: Column) -> Column:
    return F.when(F.trim(anchor) != "", F.concat(url, F.lit("#"), F.trim(anchor))).otherwise(url)


def shard_index(p: Column, prefix: str) -> Column:
    return F.regexp_extract(p, rf"{prefix}([0-9]+)\.jsonl$", 1).try_cast("long")


def safe_relative(p: Column) -> Column:
    return ~(F.startswith(p, F.lit("/")) | F.exists(F.split(p, "/"), lambda s: s == "..")) & (p != "")
