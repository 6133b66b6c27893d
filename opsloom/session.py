"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F

import opsloom

#: SQL settings every operator assumes; safe to set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows that lie sorted by their group are collected one group at a time: no table of lists that spills
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # long texts: bound a batch by its size, not by its rows alone
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SQL_SETTINGS` to an existing session.

    The package's few Python functions are sent to the executors by value, so
    it need not be installed there.
    """
    cloudpickle.register_pickle_by_value(opsloom)
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app_name: str = "opsloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings above plus ``conf``.

    Sizes such as ``spark.sql.shuffle.partitions`` belong to the cluster, so
    they are only set when the caller passes them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate results, in the shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (local mode, as in tests) may the setting be missing;
    the folder then made is removed when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_scratch() -> str:
    base = tempfile.mkdtemp(prefix="opsloom-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def cut_lineage(df, label: str):
    """Write ``df`` to the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: a scan of so many splits or fewer is one or a few small files
_FEW_SPLITS = 8


def widen(df, *keys: str):
    """Spread the rows of a single small file over all cores before costly work per row.

    A file of one row group is read by one task, however many there are.  Only
    scans of a handful of splits are spread (about a gigabyte at most); larger
    inputs stay as ``spark.sql.files.maxPartitionBytes`` cuts them, however
    many cores the cluster has.  Results do not depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > min(_FEW_SPLITS, cores - 1):
        return df
    return df.repartition(cores, *keys)


#: short texts that a task judges, at most: a split of a compressed table may hold millions
ROWS_A_TASK = 50_000


def widen_rows(df, *keys: str):
    """:func:`widen` for rows that are small on disk and costly each: tasks are cut by rows, so none grows with the table.

    Rows are counted for each split, without reading a column: files of all
    sizes make many splits, and one of them may still hold most of the rows.
    """
    splits = df.groupBy(F.spark_partition_id().alias("split")).count()
    held = splits.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (held["most"] or 0) <= ROWS_A_TASK:
        return widen(df, *keys)
    return df.repartition(max(-(-held["all"] // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)
