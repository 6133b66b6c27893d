"""Pieces that several corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.session import cut_lineage

#: the white space that separates words and is stripped from lines: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays (``lower`` would fold other scripts too)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    """How many runs without white space a text has; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.size(F.split(trimmed, _BLANK_RUN))
    return F.when(trimmed == "", F.lit(0)).otherwise(words).cast("long")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text, and ``n_chars`` to match where there is such a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def global_rank(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add ``rank``: each row's place from 0 in the order of all rows.

    A window without a partition would pull all rows into one task.  Here the
    rows are range-partitioned and sorted, written once (so that every reader
    sees the same partitions, also after a lost executor), and each partition
    is offset by the sizes of those before it: one small row per partition.
    Only rows equal in ``order`` may change places between runs.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    placed = cut_lineage(
        ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn(
            "__at", F.monotonically_increasing_id()
        ),
        label,
    )
    part = F.shiftright("__at", 33)
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # one row for each partition of the table just written
    joined = placed.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn("rank", F.col("__before") + inside).drop("__at", "__part", "__before")
