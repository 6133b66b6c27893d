"""Keyed collections of chunks: split into new and known, merge, clear, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from opsloom.session import scratch_dir

#: rows of one bucket folder of a stored collection; only the touched buckets are rewritten
ROWS_PER_BUCKET = 1_000_000


def existing_ids(collection: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The given ids that the collection holds; only the key column is read."""
    return ids.select(key).distinct().join(collection.select(key), key, "left_semi")


def split_new_and_known(
    incoming: DataFrame, collection: DataFrame, key: str = "chunk_id"
) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and rows that replace stored ones."""
    known = collection.select(key)
    return incoming.join(known, key, "left_anti"), incoming.join(known, key, "left_semi")


def upsert(collection: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The collection after the merge: incoming rows win, other rows stay.

    ``incoming`` holds each key once.  Applying it twice changes nothing.
    """
    kept = collection.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merge_counts(incoming: DataFrame, collection: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: how many incoming rows are stored anew and how many update."""
    marked = incoming.select(key).join(
        collection.select(key).withColumn("__known", F.lit(True)), key, "left"
    )
    return marked.agg(
        F.count_if(F.col("__known").isNull()).alias("stored"),
        F.count_if(F.col("__known")).alias("updated"),
        F.lit(0).cast("bigint").alias("skipped"),
    )


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _layout(columns: list[str]) -> tuple[str, str, int]:
    """Bucket column of a stored collection, the column it hashes, and the number of buckets: its name states them."""
    name = next(c for c in columns if c.startswith("bucket_of_"))
    buckets, cluster = name.removeprefix("bucket_of_").split("_by_", 1)
    return name, cluster, int(buckets)


def write_collection(rows: DataFrame, path: str, cluster: str = "chunk_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Store a collection as Parquet, one folder per bucket of ``cluster``.

    Clustered by document, all chunks of one document share a bucket.  The
    number of buckets follows from the number of rows.  Rows are rebalanced by
    bucket: large buckets are split over several writers, small ones share.
    """
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    name = f"bucket_of_{buckets}_by_{cluster}"
    bucketed = rows.withColumn(name, bucket_of(F.col(cluster), buckets))
    bucketed.hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, key: str = "chunk_id") -> None:
    """Upsert ``incoming`` into a stored collection, rewriting touched buckets only.

    A key must stay in its cluster (a chunk in its document).  The merged
    buckets are first written to the shared scratch folder, so the job never
    overwrites what it still reads; the staged copy stays until the target is
    written, so a broken merge can be repeated.
    """
    stored = read_collection(spark, path)
    name, cluster, buckets = _layout(stored.columns)
    incoming = incoming.withColumn(name, bucket_of(F.col(cluster), buckets))
    # one number per bucket comes to the driver
    touched = [r[0] for r in incoming.select(name).distinct().collect()]
    if not touched:
        return
    staging = scratch_dir(spark, "merge")
    merged = upsert(stored.where(F.col(name).isin(touched)), incoming, key)
    merged.hint("rebalance", name).write.partitionBy(name).parquet(staging)
    (
        spark.read.parquet(staging)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(name)
        .parquet(path)
    )


def clear_collection(spark: SparkSession, table: str) -> bool:
    """Drop a collection table; False when that fails or it does not exist."""
    try:
        if not spark.catalog.tableExists(table):
            return False
        spark.sql("DROP TABLE IDENTIFIER(:name)", args={"name": table})
        return True
    except AnalysisException:
        return False


def document_type_counts(documents: DataFrame) -> DataFrame:
    """Documents per type; types without documents do not appear."""
    return documents.groupBy("document_type").agg(F.count("*").alias("documents"))


def ingestion_summary(
    documents: DataFrame, chunks: DataFrame, counts: DataFrame, seconds: float | None = None
) -> DataFrame:
    """One row: documents, chunks, stored, updated and skipped counts, documents by type, duration.

    ``documents`` has a ``document_type``.  All inputs are single-row
    aggregates, combined as scalar subqueries; there are a few types only.
    """
    by_type = document_type_counts(documents).where(F.col("document_type").isNotNull())
    n_docs = documents.agg(F.count("*")).scalar()
    n_chunks = chunks.agg(F.count("*")).scalar()
    types = by_type.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("document_type", "documents"))))).scalar()
    return counts.select(
        F.when(n_docs == 0, "error").when(n_chunks == 0, "error").otherwise("success").alias("status"),
        n_docs.alias("documents_loaded"),
        n_chunks.alias("chunks_created"),
        F.col("stored").alias("chunks_stored"),
        F.col("updated").alias("chunks_updated"),
        F.col("skipped").alias("chunks_skipped"),
        types.alias("documents_by_type"),
        F.lit(seconds).cast("double").alias("duration_seconds"),
    )
