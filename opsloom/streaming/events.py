"""Windows, sessions, counters and de-duplication over unbounded input.

Each function takes a streaming (or batch) DataFrame and returns one; the
batch result over the same rows is the reference for its tests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from opsloom.operators.audit import AUDIT_SCHEMA
from opsloom.session import scratch_dir


def event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned time stamp; the session runs in UTC."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def audit_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Follow an audit folder."""
    return spark.readStream.schema(AUDIT_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def windowed_counts(
    rows: DataFrame, labels: Sequence[str], width: str = "1 hour", slide: str | None = None,
    delay: str = "10 minutes", ts: str = "ts", value: str | None = None,
) -> DataFrame:
    """Events (and the sum of a value) per tumbling or sliding window and label set."""
    aggs = [F.count("*").alias("events")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = event_time(rows, ts).withWatermark(ts, delay).groupBy(window.alias("w"), *labels).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *labels, *[c for c in ("events", "total") if c in grouped.columns])


def windowed_histogram(
    rows: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = (), width: str = "1 hour",
    delay: str = "10 minutes", ts: str = "ts",
) -> DataFrame:
    """Cumulative histogram per tumbling window: one count per bound, bounded state."""
    counts = [F.count_if(F.col(value) <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]
    grouped = (
        event_time(rows, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), *labels)
        .agg(*counts, F.count("*").alias("observations"))
    )
    return grouped.select(F.col("w.start").alias("window_start"), *labels, *[f"le_{i}" for i in range(len(bounds))], "observations")


def session_activity(
    rows: DataFrame, session: str = "session_id", gap: str = "30 minutes", delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Stretches of activity per session, closed after a gap; one state row per stretch."""
    grouped = (
        event_time(rows, ts)
        .withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), session)
        .agg(F.count("*").alias("events"))
    )
    return grouped.select(session, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def first_arrivals(rows: DataFrame, key: Sequence[str], delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return event_time(rows, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk; a restarted stream keeps the store it began with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(stream: DataFrame, label: str, output_mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Run a stream over the input present now and return what it wrote.

    Output and checkpoint lie in the shared folder.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, label)
    with state_in_rocksdb(spark) if rocksdb else nullcontext():
        query: StreamingQuery = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode(output_mode)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
