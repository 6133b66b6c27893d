"""Audit logs and message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.operators.audit import AUDIT_SCHEMA


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries from JSON lines; malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def session_audit(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's audit entries."""
    return read_audit(spark, path).where(F.col("session_id") == session_id)


def read_messages_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], lower: int, upper: int, partitions: int
) -> DataFrame:
    """Messages of a relational store, read in ``partitions`` ranges of the numeric ``id``."""
    return spark.read.jdbc(
        url, table, column="id", lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties
    )
