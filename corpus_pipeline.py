"""A training corpus in five stages: recognised languages, unique lines, one of each near copy, mixed sources, packed tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm import langid, lines, mixing, packing, simhash
from opsloom.session import configure, cut_lineage


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts in no recognised language go."""
    configure(spark)
    return langid.known_language(docs)


def unrepeat(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of three or more documents stay in one of them."""
    configure(spark)
    return lines.dedup_lines(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    configure(spark)
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as their source's target takes them."""
    configure(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: token pieces in sequences."""
    configure(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", recognise),
    ("line_dedup", unrepeat),
    ("near_dedup", distinct),
    ("mixing", mixed),
    ("packing", packed),
]

#: hashing, learning and packing are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
