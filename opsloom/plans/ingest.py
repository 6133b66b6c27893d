"""Files to a searchable collection: load, chunk, embed, merge, summarise."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.operators import collections as L
from opsloom.operators import embedding as E
from opsloom.operators import versioned as V
from opsloom.operators.chunking import chunk_documents
from opsloom.session import cut_lineage
from opsloom.sources.files import load_documents

CHUNK_COLUMNS = [
    "chunk_id", "document_id", "chunk_index", "content", "section_header", "config_block_type", "chunk_strategy",
    "source_path", "document_type", "region", "metadata",
]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a stored table, or an empty one before its first write."""
    return V.read(spark, path) if V.exists(spark, path) else spark.createDataFrame([], schema)


def ingest(
    spark: SparkSession,
    source_path: str,
    collection_path: str,
    cache_path: str,
    provider: E.EmbeddingProvider,
    prose_size: int = 1000,
    prose_overlap: int = 200,
) -> DataFrame:
    """Ingest a folder and return the one-row summary.

    Collection and cache are versioned: readers see the versions before until
    the new ones are published.  Chunks and new vectors are written to the
    shared folder once, as every later step reads them again.  Running it
    twice leaves the rows of the collection as they were after the first run.
    """
    started = time.monotonic()
    now = E.pinned_now(spark)
    # the files are read once
    documents = cut_lineage(load_documents(spark, source_path), "documents")
    keep = ["source_path", "document_type", "region", "metadata"]
    chunks = cut_lineage(chunk_documents(documents, prose_size, prose_overlap, keep), "chunks").select(*CHUNK_COLUMNS)

    cache_schema = "cache_key string, model string, embedding array<float>, cached_at timestamp"
    cached = cut_lineage(E.valid_cache(_stored(spark, cache_path, cache_schema), now), "cache")
    vectors, fresh = E.embed_documents(chunks, cached, provider, text="content", now=now)
    E.store_entries(spark, cache_path, fresh)
    ready = cut_lineage(vectors, "embedded").drop("cache_key")
    if not ready.where(F.col("embedding").isNull()).isEmpty():
        raise ValueError("chunks without a vector")

    stored = _stored(spark, collection_path, "chunk_id string")
    counts = cut_lineage(L.merge_counts(chunks, stored), "counts")
    if V.exists(spark, collection_path):
        V.merge(spark, collection_path, ready)
    else:
        V.create(spark, collection_path, ready, "chunk_id", "document_id")
    return L.ingestion_summary(documents, chunks, counts, time.monotonic() - started)
