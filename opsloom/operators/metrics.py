"""Counters, histograms, gauges and quantiles over request and tool logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
#: upper bounds of the histogram buckets
HISTOGRAM_BOUNDS = {
    "request_latency_seconds": [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0],
    "llm_latency_seconds": [0.5, 1.0, 2.0, 5.0, 10.0, 30.0],
    "confidence_score": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "tool_latency_seconds": [0.1, 0.25, 0.5, 1.0, 2.5, 5.0],
    "rag_documents_retrieved": [1, 2, 3, 5, 8, 10, 15, 20],
    "rag_relevance_score": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
}
LATENCY_QUANTILES = [0.5, 0.95, 0.99]
# --- end of fixed values ----------------------------------------------------


def counter(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Number of rows per label combination."""
    return rows.groupBy(*labels).agg(F.count("*").alias("value"))


def request_method(method: Column, failed: Column) -> Column:
    """Method label of the request counter; failures count under their own label."""
    return F.when(failed, F.concat(method, F.lit("_ERROR"))).otherwise(method)


def token_counter(rows: DataFrame) -> DataFrame:
    """Tokens by type: prompt and completion, or total where neither is given.

    ``rows``: tokens, prompt_tokens, completion_tokens.
    """
    prompt = F.coalesce("prompt_tokens", F.lit(0))
    completion = F.coalesce("completion_tokens", F.lit(0))
    only_total = (prompt == 0) & (completion == 0)
    sums = rows.agg(
        F.sum(prompt).alias("prompt"),
        F.sum(completion).alias("completion"),
        F.sum(F.when(only_total, F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("total"),
    )
    return sums.unpivot([], ["prompt", "completion", "total"], "type", "value").where(F.col("value") > 0)


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram per label set: labels, le, bucket_count, observations, total.

    One conditional count per bound, so each input row is read and aggregated
    once; the few result rows are then unpivoted.  ``le`` is null for the
    unbounded last bucket.
    """
    col = F.col(value)
    names = [f"__b{i}" for i in range(len(bounds))]
    counts = [F.count_if(col <= F.lit(float(b))).alias(n) for b, n in zip(bounds, names)]
    agg = rows.where(col.isNotNull()).groupBy(*labels).agg(
        *counts, F.count("*").alias("observations"), F.sum(col).alias("total")
    )
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("bucket_count")) for b, n in zip(bounds, names)]
    last = F.struct(F.lit(None).cast("double").alias("le"), F.col("observations").alias("bucket_count"))
    return agg.select(*labels, F.inline(F.array(*buckets, last)), "observations", "total")


def active_sessions(rows: DataFrame, session: str = "session_id", since: Column | None = None, ts: str = "ts") -> DataFrame:
    """Distinct sessions, optionally only those seen since a point in time."""
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    return rows.agg(F.count_distinct(session).alias("active_sessions"))


def knowledge_base_size(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count("*").alias("knowledge_base_chunks"))


def grounding_failures(responses: DataFrame) -> DataFrame:
    """Responses that failed their grounding check."""
    return responses.agg(F.count_if(~F.col("is_grounded")).alias("grounding_failures"))


def latency_quantiles(rows: DataFrame, value: str, labels: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """p50, p95 and p99 as mergeable sketches: bounded state however many rows a label has."""
    q = F.percentile_approx(value, LATENCY_QUANTILES, accuracy)
    return rows.groupBy(*labels).agg(q.alias("__q")).select(
        *labels, *[F.get("__q", i).alias(n) for i, n in enumerate(["p50", "p95", "p99"])]
    )
