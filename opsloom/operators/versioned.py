"""Keyed collections in versions: a manifest names the bucket folders of each, and buckets split one by one.

A collection is a folder with ``data`` (bucket folders, written once and never
changed) and ``manifests`` (one small JSON file a version).  A version is
published by moving its finished manifest into place, so a reader sees one
version or the next, never a mixture, and whoever publishes a version second
fails and may try again.

Buckets follow linear hashing.  With 2**level + split buckets, a row lies in
bucket ``hash mod 2**level``, or, if that one is among the first ``split``, in
``hash mod 2**(level + 1)``: one more bucket takes rows from a single other
one.  A collection can begin with ten rows and grow without being rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from opsloom.operators.collections import upsert

#: rows a bucket is to hold on average
ROWS_PER_BUCKET = 1_000_000
_BUCKET = "__bucket"


class VersionConflict(RuntimeError):
    """Somebody else has published the version meanwhile."""


def bucket_of(value: Column, buckets: int) -> Column:
    """The bucket of a value when there are ``buckets`` of them."""
    level = 1 << (buckets.bit_length() - 1)
    spread = F.xxhash64(value)
    low = F.pmod(spread, F.lit(level))
    return F.when(low < buckets - level, F.pmod(spread, F.lit(2 * level))).otherwise(low).cast("int")


def split_sources(before: int, after: int) -> set[int]:
    """The buckets, of ``before``, that rows leave when there are ``after`` buckets."""
    level = 1 << (before.bit_length() - 1)

    def parent(bucket: int) -> int:
        while bucket >= before:
            bucket -= 1 << (bucket.bit_length() - 1)
        return bucket

    return {parent(new) for new in range(before, after)} if after > before else set()


# --- manifests ----------------------------------------------------------------------------
def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first; empty where there is no collection."""
    return [int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/manifests")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version (the newest, unless named) consists of."""
    if version is None:
        known = versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no collection at {path}")
        version = known[-1]
    # a manifest is one line; its size goes with the number of buckets
    return json.loads(spark.read.text(f"{path}/manifests/{version:012d}.json").first()[0])


def put_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a small file unless one of that name exists: it appears whole or not at all; False if somebody was first."""
    jvm, at, fs = _hadoop(spark, folder)
    fs.mkdirs(at)
    draft = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    careful = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(at, name)), careful)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    return True


def names_in(spark: SparkSession, folder: str, suffix: str = ".json") -> list[str]:
    """Names of the files of a folder, sorted; empty where there is none."""
    _, at, fs = _hadoop(spark, folder)
    found = [status.getPath().getName() for status in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n.endswith(suffix) and not n.startswith("."))


def _publish(spark: SparkSession, path: str, content: dict) -> dict:
    if not put_once(spark, f"{path}/manifests", f"{content['version']:012d}.json", json.dumps(content)):
        raise VersionConflict(f"version {content['version']} of {path} exists")
    return content


def _write(rows: DataFrame, path: str, cluster: str, buckets: int) -> dict[str, dict]:
    """Write rows to fresh bucket folders; ``folder`` and ``rows`` by bucket."""
    folder = f"data/{uuid.uuid4().hex}"
    bucketed = rows.withColumn(_BUCKET, bucket_of(F.col(cluster), buckets))
    # large buckets go to several writers, small ones share one
    bucketed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    spark = rows.sparkSession
    # one number a bucket, from the files' footers
    counts = spark.read.schema(bucketed.schema).parquet(f"{path}/{folder}").groupBy(_BUCKET).count().collect()
    return {str(r[0]): {"folder": f"{folder}/{_BUCKET}={r[0]}", "rows": r[1]} for r in counts}


def _bucket_rows(spark: SparkSession, path: str, content: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    wanted = [b["folder"] for n, b in content["buckets"].items() if buckets is None or int(n) in buckets]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in sorted(wanted)])


# --- the collection -----------------------------------------------------------------------
def create(
    spark: SparkSession, path: str, rows: DataFrame, key: str = "chunk_id", cluster: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict:
    """Version 1 of a collection: rows with a unique ``key``, kept together by ``cluster`` (the key, unless named).

    Returns its manifest.  An empty table makes a collection without buckets in
    use.  Null clusters share a bucket.
    """
    cluster = cluster or key
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    written = _write(rows, path, cluster, buckets)
    content = {
        "version": 1, "key": key, "cluster": cluster, "rows_per_bucket": rows_per_bucket, "n_buckets": buckets,
        "rows": sum(b["rows"] for b in written.values()), "rewritten": sorted(map(int, written)),
        "schema": json.loads(rows.schema.json()), "buckets": written,
    }
    return _publish(spark, path, content)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest unless named.  What is merged later does not change it."""
    return _bucket_rows(spark, path, manifest(spark, path, version))


def read_clusters(spark: SparkSession, path: str, values: list) -> DataFrame:
    """The rows of some clusters (documents): only their buckets are opened."""
    content = manifest(spark, path)
    column = F.col(content["cluster"])
    dtype = StructType.fromJson(content["schema"])[content["cluster"]].dataType
    wanted = spark.createDataFrame([(v,) for v in values], StructType().add(content["cluster"], dtype))
    buckets = {r[0] for r in wanted.select(bucket_of(column, content["n_buckets"])).collect()}
    return _bucket_rows(spark, path, content, buckets).where(column.isin(values))


def _next(spark: SparkSession, path: str, content: dict, replaced: set[int], rows: DataFrame, n_buckets: int) -> dict:
    """Publish the version after ``content`` in which ``rows`` stand for the ``replaced`` buckets."""
    written = _write(rows, path, content["cluster"], n_buckets)
    kept = {n: b for n, b in content["buckets"].items() if int(n) not in replaced}
    buckets = kept | written
    return _publish(
        spark,
        path,
        content
        | {
            "version": content["version"] + 1,
            "n_buckets": n_buckets,
            "rows": sum(b["rows"] for b in buckets.values()),
            "rewritten": sorted(map(int, written)),
            "buckets": buckets,
        },
    )


def merge(spark: SparkSession, path: str, incoming: DataFrame) -> dict:
    """Upsert ``incoming`` (each key once) and publish; then split buckets where the rows ask for more.

    Only buckets that incoming rows fall into are rewritten, into new folders;
    a key must stay in its cluster.  New columns are added to the schema, null
    in older rows.  Nothing is published for an empty input.  A merge that
    breaks has changed nothing; merged again, the same rows change nothing.
    Returns the newest manifest.
    """
    content = manifest(spark, path)
    cluster = F.col(content["cluster"])
    # one number a bucket comes to the driver
    touched = {r[0] for r in incoming.select(bucket_of(cluster, content["n_buckets"])).distinct().collect()}
    if not touched:
        return content
    stored = _bucket_rows(spark, path, content, touched)
    new = [c for c in incoming.columns if c not in stored.columns]
    merged = upsert(stored.select("*", *[F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in new]), incoming, content["key"])
    content = content | {"schema": json.loads(merged.schema.json())}
    return _split(spark, path, _next(spark, path, content, touched, merged, content["n_buckets"]))


def _split(spark: SparkSession, path: str, content: dict) -> dict:
    """As many more buckets as the rows ask for; rows move out of the split buckets only."""
    wanted = -(-content["rows"] // content["rows_per_bucket"])
    if wanted <= content["n_buckets"]:
        return content
    sources = split_sources(content["n_buckets"], wanted)
    return _next(spark, path, content, sources, _bucket_rows(spark, path, content, sources), wanted)


def remove_where(spark: SparkSession, path: str, gone: Column) -> dict:
    """Drop rows for which ``gone`` is true and publish; buckets without such a row are not rewritten."""
    content = manifest(spark, path)
    rows = _bucket_rows(spark, path, content)
    doomed = rows.where(gone).select(bucket_of(F.col(content["cluster"]), content["n_buckets"])).distinct()
    touched = {r[0] for r in doomed.collect()}
    if not touched:
        return content
    kept = _bucket_rows(spark, path, content, touched).where(~F.coalesce(gone, F.lit(False)))
    return _next(spark, path, content, touched, kept, content["n_buckets"])


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row a published version: ``version, rows, buckets, rewritten`` (how many buckets it wrote)."""
    known = [manifest(spark, path, v) for v in versions(spark, path)]
    rows = [(m["version"], m["rows"], m["n_buckets"], len(m["rewritten"])) for m in known]
    return spark.createDataFrame(rows, "version long, rows long, buckets int, rewritten int")


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the folders only they named; how many versions went.

    Folders of unfinished merges go too, so no merge may run meanwhile.
    """
    known = versions(spark, path)
    old, kept = known[:-keep], known[-keep:]
    needed = {b["folder"].split("/")[1] for v in kept for b in manifest(spark, path, v)["buckets"].values()}
    jvm, folder, fs = _hadoop(spark, f"{path}/manifests")
    for v in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{v:012d}.json"), False)
    _, data, _ = _hadoop(spark, f"{path}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in needed:
            fs.delete(status.getPath(), True)
    return len(old)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a collection has been published at ``path``."""
    return bool(versions(spark, path))
