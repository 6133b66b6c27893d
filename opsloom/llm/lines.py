"""Line de-duplication by range-partitioned hashes, returned as keep bitmaps.

All of it is DataFrame operations.  A line is reduced to a 128-bit hash of its
key; texts are not moved until the bitmaps are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.text import let
from opsloom.llm.shared import BLANKS, ascii_lower, with_text
from opsloom.session import cut_lineage

MIN_POINTS = 20
MIN_DOCS = 3
#: a line key is hot when it holds more than one line in HOT_SHARE: fewer than HOT_SHARE keys can
HOT_SHARE = 1000
#: items the frequency sketch tracks; it finds every key above 1/12288 of all lines
_TRACKED = 16384


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """One row per line long enough to be compared: ``doc_id, version, pos, h1, h2``.

    ``version`` is a hash of the text, so that rows sharing a ``doc_id`` keep
    bitmaps of their own.
    """
    rows = docs.select("doc_id", _text(docs).alias("__text"))
    split = rows.select(
        "doc_id",
        F.xxhash64("__text").alias("version"),
        F.posexplode(F.split("__text", "\n", -1)).alias("pos", "__line"),
    )
    trimmed = split.select("doc_id", "version", "pos", F.btrim("__line", F.lit(BLANKS)).alias("__line")).where(
        F.length("__line") >= min_points
    )
    keyed = trimmed.select("doc_id", "version", "pos", ascii_lower(F.col("__line")).alias("__key"))
    return keyed.select(
        "doc_id", "version", "pos", F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(1), "__key").alias("h2")
    )


def _hot_keys(lines: DataFrame, share: int) -> list[int]:
    """First hashes of lines that hold more than 1/share of all lines: fewer than ``share`` numbers."""
    found = lines.agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(h1, {share}, {_TRACKED})").alias("top"),
    ).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * share > found["n"]]


def dropped_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``doc_id, version, pos`` of the lines to drop.

    Hashes are range-partitioned and sorted by document (largest first) and
    position, so one pass over a partition meets the line that stays before
    the others of its key.  The few hot keys would each fill a partition; for
    them, the staying document and the number of documents are pre-aggregated
    and sent to their lines, which do not move at all.
    """
    lines = cut_lineage(line_hashes(docs, min_points), "line-hashes")
    hot = F.col("h1").isin(_hot_keys(lines, hot_share))

    key = ["h1", "h2"]
    run = Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last(), "version", "pos")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new_doc = (F.row_number().over(run) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    streamed = (
        lines.where(~hot)
        .repartitionByRange(*key)
        .withColumn("__new", new_doc.cast("int"))
        .withColumn("__doc", F.sum("__new").over(so_far))
        .withColumn("__docs", F.max("__doc").over(Window.partitionBy(*key)))
    )
    cold_drops = streamed.where((F.col("__docs") >= min_docs) & (F.col("__doc") > 1))

    summary = (
        lines.where(hot)
        .select(*key, "doc_id")
        .distinct()
        .groupBy(*key)
        .agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__docs"))
        .where(F.col("__docs") >= min_docs)
    )
    # fewer than `hot_share` rows by construction
    hot_drops = (
        lines.where(hot).join(F.broadcast(summary), key).where(~F.col("doc_id").eqNullSafe(F.col("__keep")))
    )
    place = ["doc_id", "version", "pos"]
    return cold_drops.select(*place).unionByName(hot_drops.select(*place))


def keep_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, hot_share: int = HOT_SHARE) -> DataFrame:
    """Compressed keep bitmaps: ``doc_id, version, n_dropped, bitmap``, one row per text that loses lines.

    ``bitmap`` is a list of ``(word, bits)``: bit *i* of word *w* tells whether
    line ``64 w + i`` (from 0) stays.  Words that keep all their lines are left
    out, and so are texts that lose nothing.

    Line keys, and what is dropped: a line is stripped of ASCII white space and
    A-Z lower-cased; a key of at least ``min_points`` code points held by
    ``min_docs`` or more documents stays in the largest ``doc_id`` only, with
    all its lines there.  Null and empty texts are one empty line.  A null
    ``doc_id`` is one document, smaller than all others.  Rows that share a
    ``doc_id`` count as one document; whole repeated rows get equal bitmaps.
    """
    by_text = ["doc_id", "version"]
    words = (
        dropped_lines(docs, min_points, min_docs, hot_share)
        .repartition(*by_text)
        .groupBy(*by_text, F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    )
    return words.groupBy(*by_text).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("bitmap"),
    )


def _kept(text: Column, bitmap: Column) -> Column:
    """The lines of ``text`` whose bit is set, joined again."""
    lines = F.split(text, "\n", -1)
    words = let(
        F.map_from_entries(bitmap),
        lambda known: F.transform(
            F.sequence(F.lit(0), F.array_max(F.map_keys(known))),
            lambda w: F.coalesce(known[w], F.lit(-1).cast("long")),
        ),
    )

    def stays(words: Column, i: Column) -> Column:
        at = F.shiftright(i, 6)
        return F.when(at < F.size(words), F.call_function("getbit", F.get(words, at), i % 64) == 1).otherwise(True)

    return let(words, lambda ws: F.array_join(F.filter(lines, lambda x, i: stays(ws, i)), "\n"))


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the bitmap of each text as ``__bitmap`` and ``__dropped`` (null: all lines stay).

    Texts are shuffled once; the bitmaps are the small, hashed side of the join.
    """
    right = bitmaps.select(
        F.col("doc_id").alias("__id"),
        F.col("version").alias("__version"),
        F.col("n_dropped").alias("__dropped"),
        F.col("bitmap").alias("__bitmap"),
    ).hint("shuffle_hash")
    own = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(_text(docs)) == F.col("__version"))
    return docs.join(right, own, "left").drop("__id", "__version")


def _new_text() -> Column:
    body = F.coalesce("text", F.lit(""))
    return F.when(F.col("__bitmap").isNull(), body).otherwise(_kept(body, F.col("__bitmap")))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines`` (before), ``n_dropped`` and the kept lines as ``text``, one row per document."""
    return _joined(docs.select("doc_id", "text"), bitmaps).select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
        _new_text().alias("text"),
    )


def dedup_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """Documents without their repeated lines, columns unchanged; every document stays, if only with an empty text."""
    return with_text(_joined(docs, keep_bitmaps(docs, **limits)), _new_text()).select(*docs.columns)
