"""Text to vectors: provider boundary, content-hash cache, cache-first embedding."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsloom.functions.text import embedding_cache_key, let, tokens
from opsloom.operators import versioned
from opsloom.operators.skew import lookup
from opsloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------
BATCH_SIZE = 100
CACHE_TTL_SECONDS = 7 * 86400
MAX_RETRIES = 5
BASE_DELAY = 1.0
MAX_DELAY = 60.0
RATE_LIMIT_SIGNS = ["rate limit", "429", "too many requests", "quota"]
# --- end of fixed values ----------------------------------------------------


class EmbeddingProvider(Protocol):
    """What a provider offers.  It is sent to the tasks; connect in :meth:`open`."""

    name: str
    dimensions: int

    def open(self) -> None:
        """Called once per task, before the first batch."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector per text, in order."""

    def close(self) -> None:
        """Called once per task, after the last batch."""


#: a provider may also offer ``column(text)``, the vector as a column expression; it is then used instead


class HashingProvider:
    """Offline default: hashed counts of lower-case tokens, scaled to length one."""

    def __init__(self, dimensions: int = 64) -> None:
        self.name = f"hashing-{dimensions}"
        self.dimensions = dimensions

    def open(self) -> None:
        dims = self.dimensions
        self._bucket = lru_cache(maxsize=100_000)(
            lambda token: int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dims
        )

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not hasattr(self, "_bucket"):
            self.open()
        out = []
        for text in texts:
            buckets = [self._bucket(t) for t in text.lower().split()]
            counts = np.bincount(buckets, minlength=self.dimensions).astype("float64") if buckets else np.zeros(self.dimensions)
            norm = np.linalg.norm(counts)
            out.append((counts / norm if norm else counts).tolist())
        return out

    def column(self, text: Column) -> Column:
        """The same vector as an expression: counts per bucket of the hashed tokens, scaled to length one."""

        def counts(buckets: Column) -> Column:
            dims = F.sequence(F.lit(0), F.lit(self.dimensions - 1))
            return F.transform(dims, lambda d: (F.size(buckets) - F.size(F.array_remove(buckets, d))).cast("double"))

        def scaled(n: Column) -> Column:
            length = F.sqrt(F.aggregate(n, F.lit(0.0), lambda total, x: total + x * x))
            return let(length, lambda norm: F.transform(n, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")))

        def bucket(token: Column) -> Column:
            head = F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("long")
            return F.pmod(head, F.lit(self.dimensions)).cast("int")

        found = F.transform(tokens(F.lower(F.coalesce(text, F.lit("")))), bucket)
        return let(let(found, counts), scaled)

    def close(self) -> None:
        self.__dict__.pop("_bucket", None)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_bucket"}


class EmbeddingError(RuntimeError):
    """A provider failed for good."""


def backoff_delay(attempt: int, base: float = BASE_DELAY, limit: float = MAX_DELAY) -> float:
    """Seconds to wait after a failed attempt (counted from 0)."""
    return min(base * 2**attempt, limit)


def call_with_retry(provider: EmbeddingProvider, texts: list[str], sleep=time.sleep) -> list[list[float]]:
    """Vectors of a batch; only rate limits are worth another attempt, each after a longer wait."""
    waits = [backoff_delay(attempt) for attempt in range(MAX_RETRIES - 1)]
    while True:
        try:
            return provider.embed(texts)
        except Exception as error:
            said = str(error).lower()
            if not any(sign in said for sign in RATE_LIMIT_SIGNS):
                raise EmbeddingError(f"Embedding failed: {error}") from error
            if not waits:
                raise EmbeddingError(f"Embedding failed after {MAX_RETRIES} attempts") from error
        sleep(waits.pop(0))


def embed_column(texts: DataFrame, text: str, provider: EmbeddingProvider, output: str = "embedding") -> DataFrame:
    """Add a vector per row: the provider's own expression, or its batches of 100 within each Arrow batch."""
    if hasattr(provider, "column"):
        return texts.withColumn(output, provider.column(F.col(text)))
    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + f", `{output}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        try:
            for batch in batches:
                values = batch[text].tolist()
                vectors: list[list[float]] = []
                for start in range(0, len(values), BATCH_SIZE):
                    vectors.extend(call_with_retry(provider, values[start : start + BATCH_SIZE]))
                yield batch.assign(**{output: vectors})
        finally:
            provider.close()

    return texts.mapInPandas(run, schema)


def valid_cache(cache: DataFrame, now=None, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Cache entries that have not expired."""
    now = F.current_timestamp() if now is None else now
    age = F.unix_seconds(now) - F.unix_seconds(F.col("cached_at").cast("timestamp"))
    return cache.where(age < ttl_seconds)


def latest_entries(cache: DataFrame) -> DataFrame:
    """One entry a key: the one cached last (ties: the greatest vector).  Doubles collapse before the shuffle."""
    others = [c for c in cache.columns if c not in ("cache_key", "cached_at")]
    newest = F.max(F.struct("cached_at", *others)).alias("__e")
    return cache.groupBy("cache_key").agg(newest).select(*[F.col(c) if c == "cache_key" else F.col("__e")[c].alias(c) for c in cache.columns])


def store_entries(spark: SparkSession, path: str, fresh: DataFrame, rows_per_bucket: int = versioned.ROWS_PER_BUCKET) -> None:
    """Add entries to the cache at ``path``, a versioned collection: an entry replaces an older one of its key."""
    fresh = latest_entries(fresh)
    if versioned.exists(spark, path):
        versioned.merge(spark, path, fresh)
    else:
        versioned.create(spark, path, fresh, "cache_key", rows_per_bucket=rows_per_bucket)


def compact_cache(spark: SparkSession, path: str, now: Column | None = None, ttl_seconds: int = CACHE_TTL_SECONDS, keep_versions: int = 2) -> None:
    """Drop expired entries from a stored cache, rewriting only the buckets that hold one, and forget old versions."""
    now = F.current_timestamp() if now is None else now
    age = F.unix_seconds(now) - F.unix_seconds(F.col("cached_at").cast("timestamp"))
    versioned.remove_where(spark, path, age >= ttl_seconds)
    versioned.forget(spark, path, keep_versions)


def cache_lookup(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Each text with its cached vector, or null.  Safe when one text fills a third of the rows."""
    keyed = texts.withColumn("cache_key", embedding_cache_key(F.col(text), model))
    return lookup(keyed, cache, "cache_key", ["embedding"])


def missing_texts(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts without a cache entry: ``cache_key, text``.

    Copies collapse in the map-side aggregate, so each text is embedded once.
    """
    keyed = texts.select(embedding_cache_key(F.col(text), model).alias("cache_key"), F.col(text).alias("text"))
    distinct = keyed.groupBy("cache_key").agg(F.any_value("text").alias("text"))
    return distinct.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_missing(
    texts: DataFrame, cache: DataFrame, provider: EmbeddingProvider, model: str | None = None, text: str = "text", now=None
) -> DataFrame:
    """New cache entries for the texts that have none: cache_key, model, embedding, cached_at.

    Add these with :func:`store_entries`, then use :func:`cache_lookup`.
    """
    model = model or provider.name
    missing = missing_texts(texts, cache, model, text)
    stamped = embed_column(missing, "text", provider)
    return stamped.select(
        "cache_key",
        F.lit(model).alias("model"),
        "embedding",
        (F.current_timestamp() if now is None else now).alias("cached_at"),
    )


def embed_documents(
    texts: DataFrame, cache: DataFrame, provider: EmbeddingProvider, model: str | None = None, text: str = "text", now=None
) -> tuple[DataFrame, DataFrame]:
    """Vectors for all rows, cache first; also returns the entries to add to the cache.

    The new entries are written to the shared folder here, as both frames read
    them: the provider is asked once for each missing text.  ``now`` decides
    once which entries have expired.
    """
    model = model or provider.name
    now = pinned_now(cache.sparkSession) if now is None else now
    live = latest_entries(valid_cache(cache, now))
    fresh = cut_lineage(embed_missing(texts, live, provider, model, text, now), "vectors")
    both = live.select("cache_key", "embedding").unionByName(fresh.select("cache_key", "embedding"))
    return cache_lookup(texts, both, model, text), fresh


def pinned_now(spark: SparkSession) -> Column:
    """The present as a literal, so that every job of a run sees the same moment."""
    return F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
