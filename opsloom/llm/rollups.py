"""Token totals by source, language and tokenizer version, maintained from signed changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from opsloom.llm.packing import Encoder, tokenizer_path

KEY = ["source", "lang", "version"]
_TOTALS = "source string, lang string, version string, docs long, tokens long, batch string"


def counter(vocabulary: str) -> Callable[[str], int]:
    """How many tokens a text has by a vocabulary file: a ``.json`` one, or ranks (``.tiktoken``)."""
    path = tokenizer_path(vocabulary)
    if vocabulary.endswith(".json"):
        encoder = Encoder(path)
        return lambda text: len(encoder.ids(text))
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = dict(Encoder._rank(line) for line in lines)
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_counts(docs: DataFrame, keep: list[str], counts: dict[str, tuple[str, str]]) -> DataFrame:
    """``keep`` columns and, per entry of ``counts`` (name: text column, vocabulary), the tokens of the whole text.

    A null or empty text has none.  Repeated rows are counted each, an empty
    table gives no rows, and texts of any length are encoded whole.
    """
    texts = sorted({text for text, _ in counts.values()})
    kept = docs.select(*keep).schema.fieldNames()
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes), *(f"`{n}` long" for n in counts)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_vocabulary = {v: counter(v) for v in {v for _, v in counts.values()}}
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            for text, vocabulary in counts.values():
                measure = by_vocabulary[vocabulary]
                values = batch.column(len(kept) + texts.index(text))
                columns.append(pa.array((measure(v.as_py()) if v.is_valid else 0 for v in values), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *counts])

    return docs.select(*keep, *[F.col(t).alias(f"__text{i}") for i, t in enumerate(texts)]).mapInArrow(count, schema)


def inserted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that add documents: no image before."""
    now = F.struct("source", "lang", tokens.cast("long").alias("tokens"))
    return docs.select("doc_id", F.lit(version).alias("version"), F.lit(None).cast("struct<source:string,lang:string,tokens:bigint>").alias("before"), now.alias("after"))


def deleted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that remove documents: no image after."""
    return inserted(docs, version, tokens).select("doc_id", "version", F.col("after").alias("before"), F.col("before").alias("after"))


def revised(docs: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Changes of the count of documents that stay in their source and language."""
    images = [F.struct("source", "lang", c.cast("long").alias("tokens")).alias(n) for n, c in (("before", old), ("after", new))]
    return docs.select("doc_id", F.lit(version).alias("version"), *images)


def signed_totals(changes: DataFrame) -> DataFrame:
    """What changes (``version, before, after``) add to the totals: ``source, lang, version, docs, tokens``.

    The image after counts plus, the image before counts minus; a document that
    moves between sources takes its count along.  Sums are additive, so they
    are formed before the shuffle and a hot source costs one row per task.
    """
    signs = F.filter(
        F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("image"))),
        lambda s: s["image"].isNotNull(),
    )
    rows = changes.select("version", F.explode(signs).alias("s"))
    tokens = F.col("s.sign") * F.coalesce("s.image.tokens", F.lit(0))
    return rows.groupBy(F.col("s.image.source").alias("source"), F.col("s.image.lang").alias("lang"), "version").agg(
        F.sum("s.sign").cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens")
    )


def commit(path: str, batch: str, changes: DataFrame) -> None:
    """Add a batch of changes to the rollup at ``path`` (a shared folder).

    A batch is one partition of the table, replaced as a whole when its job
    commits.  Sending a batch again, after a crash or by mistake, therefore
    changes nothing, and a broken job leaves what was there.  Repeated rows
    within a batch are changes of their own.  A batch that comes to nothing
    replaces what it held before by a row of zeros.
    """
    rows = signed_totals(changes).where((F.col("docs") != 0) | (F.col("tokens") != 0))
    spark = changes.sparkSession
    # without a row, the overwrite would leave the partition as it was
    marker = spark.createDataFrame([(None, None, None, 0, 0)], "source string, lang string, version string, docs long, tokens long")
    rows = rows.unionByName(marker).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of all committed batches: ``source, lang, version, docs, tokens``.

    Reads one row per group and batch, never a document.  Groups that have come
    back to nothing are left out.  Null sources and languages are groups of
    their own.
    """
    rows = spark.read.schema(StructType.fromDDL(_TOTALS)).parquet(path)
    summed = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.where((F.col("docs") != 0) | (F.col("tokens") != 0))
