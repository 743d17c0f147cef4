"""Writers: sharded JSON, manifests, upserts, portable bundles."""

from __future__ import annotations

import hashlib
import io
import json
import re
import shutil
import tarfile
import uuid
from datetime import UTC, datetime
from pathlib import Path

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 5000
#: What each stage leaves.
TARGETS = {"fetch": ("html",), "struct": ("md",), "chunk": ("chunks",), "embed": ("vectors",), "deploy": ("collection", "postings")}


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path): the same for local folders and shared stores."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def next_shard(spark: SparkSession, path: str, prefix: str) -> int:
    """One more than the largest index of <prefix><index>.jsonl below path; 0 without any."""
    files, at = file_system(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(m[1]) for n in names if (m := re.fullmatch(rf"{re.escape(prefix)}([0-9]+)\.jsonl", n))), default=-1) + 1


def write_shards(rows: DataFrame, path: str, append: bool = False, prefix: str = "chunks-") -> int:
    """Shards <prefix>00000.jsonl and on, of SHARD_ROWS rows at most; append goes on after the largest index there is.

    Spark writes beside them; whole files are renamed then, so that a reader sees no half of one. Returns how many.
    """
    spark = rows.sparkSession
    files, at = file_system(spark, path)
    if not append:
        files.delete(at, True)
    files.mkdirs(at)
    begin, new = next_shard(spark, path, prefix), f"{path}/_new-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", SHARD_ROWS).json(new)
    _, folder = file_system(spark, new)
    made = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    for k, name in enumerate(made, begin):
        files.rename(file_system(spark, name)[1], file_system(spark, f"{path}/{prefix}{k:05d}.jsonl")[1])
    files.delete(folder, True)
    return len(made)


def write_manifest(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def manifest(totals: DataFrame, stage: str, source: str, out: str, started: datetime, **config: object) -> DataFrame:
    """A stage's totals with what it read and wrote, when, and its settings: one row for write_manifest()."""
    said = {"stage": stage, "input_root": source, "output_root": out, "started_at": started.isoformat(), "finished_at": datetime.now(UTC).isoformat()}
    return totals.withColumns({k: F.lit(v) for k, v in {**said, **config}.items()})


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of both, the last of each key; rows are reduced before the shuffle, so a frequent key is a few rows there."""
    both = old.unionByName(new)
    last = both.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("__r"))
    return last.select("__r.*")


def publish(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Write beside the path and swap, so that readers see the old table or the new one."""
    files, at = file_system(rows.sparkSession, path)
    (_, new), (_, old) = (file_system(rows.sparkSession, f"{path}.{x}") for x in ("new", "old"))
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}.new")
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)


class DimensionMismatch(ValueError):
    """Vectors of another dimension than their collection's, or of several."""


def collection(spark: SparkSession, path: str) -> dict | None:
    """What a collection is: its vectors' size and distance; null where there is none."""
    files, at = file_system(spark, f"{path}/collection.json")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/collection.json").collect())) if files.exists(at) else None


def ensure_collection(spark: SparkSession, path: str, size: int, recreate: bool = False) -> dict:
    """Create a collection of vectors of a size, or check that it is of that size; recreate drops what is there."""
    files, at = file_system(spark, path)
    if recreate:
        files.delete(at, True)
    if (found := collection(spark, path)) is not None:
        if found["size"] != size:
            raise DimensionMismatch(f"collection {path} has vectors of size {found['size']}, the input's have {size}")
        return found
    made = {"size": size, "distance": "Cosine"}
    files.mkdirs(at)
    out = files.create(file_system(spark, f"{path}/collection.json")[1], True)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    return made


def deploy(vectors: DataFrame, path: str, recreate: bool = False) -> dict:
    """Upsert vectors(id, vector, version_bucket, ...) into the collection at path, partitioned by version; returns what it
    holds then. Nothing is written unless all vectors have one dimension and it is the collection's."""
    spark = vectors.sparkSession
    n = F.size("vector")
    sizes = vectors.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most")).first()
    if not sizes["n"]:
        raise ValueError("no vectors to deploy")
    if sizes["least"] != sizes["most"]:
        raise DimensionMismatch(f"vectors have sizes from {sizes['least']} to {sizes['most']}")
    ensure_collection(spark, path, sizes["most"], recreate)
    points = f"{path}/points"
    new = vectors.withColumn("__new", F.lit(1))
    files, at = file_system(spark, points)
    if files.exists(at):
        old = spark.read.parquet(points).withColumn("__new", F.lit(0))
        # An id that comes again may come with another version, so the id alone decides.
        new = upsert(old.select(*new.columns), new, order="__new")
    else:
        new = upsert(new.limit(0), new, order="__new")
    publish(new.drop("__new"), points, ("version_bucket",) if "version_bucket" in vectors.columns else ())
    return collection(spark, path) | {"points": spark.read.parquet(points).count(), "upserted": sizes["n"]}


def deploy_bundle(spark: SparkSession, bundle_path: str, root: str, path: str, recreate: bool = False) -> dict:
    """Extract a bundle's vectors alone below root, then deploy() them."""
    extract_bundle(bundle_path, root, ("vectors",))
    return deploy(spark.read.parquet(f"{root}/vectors"), path, recreate)


def safe(path: str) -> bool:
    return not path.startswith("/") and ".." not in path.split("/") and path != ""


def bundle(root: str, out: str, parts: tuple[str, ...] = ("chunks", "vectors")) -> dict:
    """A tar.zst of the parts below root with a manifest of sizes and hashes; returns the manifest."""
    files = sorted(p for part in parts for p in Path(root, part).rglob("*") if p.is_file())
    entries = [{"path": p.relative_to(root).as_posix(), "size_bytes": p.stat().st_size, "sha1": hashlib.sha1(p.read_bytes()).hexdigest()} for p in files]
    manifest = {"files": entries, "file_count": len(entries), "total_bytes": sum(e["size_bytes"] for e in entries)}
    with open(out, "wb") as raw, zstandard.ZstdCompressor(level=3).stream_writer(raw) as z, tarfile.open(fileobj=z, mode="w|") as tar:
        head = json.dumps(manifest).encode()
        info = tarfile.TarInfo("manifest.json")
        info.size = len(head)
        tar.addfile(info, io.BytesIO(head))
        for p in files:
            tar.add(p, p.relative_to(root).as_posix())
    return manifest


def inspect_bundle(path: str) -> dict:
    with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as z, tarfile.open(fileobj=z, mode="r|") as tar:
        for member in tar:
            if member.name == "manifest.json":
                return json.load(tar.extractfile(member))
    raise ValueError("a bundle without a manifest")


def extract_bundle(path: str, root: str, only: tuple[str, ...] | None = None) -> list[str]:
    """Files written; paths that leave root are refused, hashes are checked."""
    want = {e["path"]: e["sha1"] for e in inspect_bundle(path)["files"]}
    done = []
    with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as z, tarfile.open(fileobj=z, mode="r|") as tar:
        for member in tar:
            if member.name == "manifest.json" or (only and member.name.split("/")[0] not in only):
                continue
            if not safe(member.name) or not member.isfile():
                raise ValueError(f"unsafe path in bundle: {member.name}")
            data = tar.extractfile(member).read()
            if hashlib.sha1(data).hexdigest() != want.get(member.name):
                raise ValueError(f"hash differs: {member.name}")
            target = Path(root, member.name)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
            done.append(member.name)
    return done


def clear(root: str, stages: tuple[str, ...] = tuple(TARGETS)) -> list[str]:
    """Remove what the stages left; returns what was there."""
    found = [str(p) for s in stages for t in TARGETS[s] if (p := Path(root, t)).exists()]
    for p in found:
        shutil.rmtree(p)
    return found
