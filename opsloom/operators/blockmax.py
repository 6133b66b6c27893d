"""BM25 from impact-ordered postings: what cannot reach the k-th score is not read; exact.

The postings of a term are stored by falling impact (the part of the score
that does not depend on the question), in blocks with the greatest impact of
each.  A question reads its terms' postings from the top, in rounds, until no
document outside of what was read can reach the k-th score; the few documents
that still may are then looked up in the counts of the question's terms, which
lie as the documents do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsloom.functions.text import tokens
from opsloom.operators.postings import term_counts
from opsloom.operators.retrieval import BM25_B, BM25_K1, SCORE_DIGITS, with_rank
from opsloom.session import cut_lineage

BUCKETS = 64
#: postings of a block are at most two to this power
BLOCK_BITS = 10
#: blocks a term gives in the first round, and how many times as many in each later one
FIRST_BLOCKS, GROWTH = 4, 4
_MARGIN = 2.0 * 10.0**-SCORE_DIGITS


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _impact(mean: Column) -> Column:
    """The part of a score that does not depend on the question, from ``tf`` and ``length``."""
    share = F.lit(1.0 - BM25_B) + F.lit(BM25_B) * F.col("length") / mean
    return F.col("tf") * (BM25_K1 + 1.0) / (F.col("tf") + F.lit(BM25_K1) * share)


def write_index(corpus: DataFrame, path: str, id_col: str, text: str = "content", block_bits: int = BLOCK_BITS) -> None:
    """Store the counts of each document, the postings by term and falling impact, the blocks and the corpus statistics.

    Postings are range-partitioned by term and impact, so a term in every
    document lies in as many parts as it fills.  Texts are taken apart and
    counted once, in their rows.  A null text counts as a document but has no
    length.
    """
    spark = corpus.sparkSession
    term_counts(corpus, id_col, tokens(F.lower(F.col(text)))).write.parquet(f"{path}/documents")
    counted = spark.read.parquet(f"{path}/documents")
    stats = counted.where("term IS NULL").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    stats.write.parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").select("mean_length").scalar()
    rows = counted.where("term IS NOT NULL").select("term", "id", _impact(mean).alias("impact"))

    order = ["term", F.desc("impact"), "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_bits)).write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    blocks = stored.groupBy("term", "block").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count("*").alias("n"))
    blocks.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/blocks")


def _asked_blocks(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    buckets = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("term").isin(terms))
    return cut_lineage(blocks.select("term", "most", "least", "n"), "asked-blocks")


def top_k(spark: SparkSession, path: str, terms: Sequence[str], k: int, id_col: str) -> tuple[DataFrame, dict[str, int]]:
    """Top ``k`` documents by BM25 over all terms: id, score, rank; and how many postings were read, of how many.

    Each round reads, by predicates on term and impact that reach the files,
    the postings above one impact a term.  Only numbers a term, and the k-th
    score, come to the driver.  Terms nobody uses have no part; without any
    known term, nothing is found.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    blocks = _asked_blocks(spark, path, terms)
    df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    n = spark.read.parquet(f"{path}/stats").first()["n"]
    counter = {"read": 0, "of": sum(df.values()), "rounds": 0}
    known = sorted(df)
    table = spark.createDataFrame([(t, df[t]) for t in known], "term string, df long").select(
        "term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    idf = {r["term"]: r["idf"] for r in table.collect()}
    postings = spark.read.parquet(f"{path}/postings")
    empty = spark.createDataFrame([], postings.select(F.col("id").alias(id_col), F.col("impact").alias("score")).schema)
    if not known:
        return with_rank(empty, "score", id_col), counter

    weight = F.create_map(*[F.lit(x) for t in known for x in (t, idf[t])])[F.col("term")]
    wanted = FIRST_BLOCKS
    while True:
        counter["rounds"] += 1
        cut = _cut_impacts(blocks, known, wanted)
        above = F.lit(False)
        for t, (least, _) in cut.items():
            above = above | ((F.col("term") == t) & (F.col("impact") >= least))
        seen = postings.where(above).select("id", "term", (weight * F.col("impact")).alias("part"))
        per_doc = cut_lineage(
            seen.groupBy("id").agg(F.sum("part").alias("low"), F.collect_set("term").alias("terms"), F.count("*").alias("n")), "scored"
        )
        counter["read"] = per_doc.agg(F.sum("n")).first()[0] or 0
        unread = {t: 0.0 if done else idf[t] * least for t, (least, done) in cut.items()}
        outside = sum(unread.values())
        best = per_doc.select("low").orderBy(F.desc("low")).limit(k).agg(F.count("*").alias("n"), F.min("low").alias("kth")).first()
        if outside == 0.0 or best["n"] == k and best["kth"] > outside + _MARGIN:
            break
        wanted *= GROWTH
    missing = F.lit(0.0)
    for t, rest in unread.items():
        missing = missing + F.when(F.array_contains("terms", t), 0.0).otherwise(rest)
    kth = best["kth"] if best["n"] == k else 0.0
    close = cut_lineage(per_doc.where(F.col("low") + missing >= kth - _MARGIN).select("id"), "close")
    mean = spark.read.parquet(f"{path}/stats").select("mean_length").scalar()
    by_document = spark.read.parquet(f"{path}/documents").where(F.col("term").isin(known)).join(close, "id", "left_semi")
    looked_up = by_document.select("id", "term", _impact(mean).alias("impact"))
    scored = looked_up.groupBy(F.col("id").alias(id_col)).agg(F.round(F.sum(weight * F.col("impact")), SCORE_DIGITS).alias("score"))
    return with_rank(scored.orderBy(F.desc("score"), id_col).limit(k), "score", id_col), counter


def _cut_impacts(blocks: DataFrame, terms: list[str], wanted: int) -> dict[str, tuple[float, bool]]:
    """The least impact in the ``wanted`` top blocks of each term, and whether these are all of its blocks."""
    ranked = blocks.withColumn("at", F.expr("row_number() OVER (PARTITION BY term ORDER BY most DESC, least DESC)"))
    top = ranked.where(F.col("at") <= wanted).groupBy("term").agg(F.min("least").alias("least"))
    whole = blocks.groupBy("term").agg(F.min("least").alias("last"))
    return {r["term"]: (r["least"], r["least"] <= r["last"]) for r in top.join(whole, "term").collect()}
