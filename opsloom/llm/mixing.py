"""Mixing sources to target weights by exponential-key sampling without replacement.

Every document draws an exponential key, scaled by its quality weight; within a
source the smallest keys are taken until the word budget is met.  The draw is a
hash, so reruns agree.  Decisions are one threshold per source: documents are
never gathered, ranked or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.llm.shared import word_count
from opsloom.session import cut_lineage

#: weights of the sources in the order of their names, repeating
WEIGHTS = (5, 2, 1)
#: words of the mix, in words of the corpus
SHARE = 1.5
#: a source is taken at most so often
MOST_EPOCHS = 2
#: steps of one level of the prefix sum
_STEPS = 4096
_SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: near 1 where words have about five characters each, low for junk of long or single signs."""
    per_word = F.length(text).cast("double") / F.when(size > 0, size).cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.abs(per_word - F.lit(6.0)) / F.lit(6.0)), F.lit(0.5))


def exponential_key(doc_id: Column, weight: Column, seed: str = _SEED) -> Column:
    """An exponential variate with rate ``weight``, drawn from a hash of the id (ascending keys = sampling order)."""
    label = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.md5(label.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((drawn + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target``: the words to take of each source.

    The whole of ``share`` times all words is dealt by weight; a source stops
    at ``most`` times its own size and the excess goes to the others by weight
    until none is above.  That fixed point is ``min(cap, level * weight)``:
    sources fill up in the order of cap over weight, and the level is the
    highest of "what is left over weights that are left" along that order.
    There is one row per source here, so the windows are over sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("__w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights)))
    capped = named.withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(filling), F.lit(0.0))
    weight_left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(filling), F.lit(0.0))
    level = capped.withColumn("__level", left / weight_left).withColumn("__level", F.max("__level").over(everything))
    return level.select("source", "source_size", F.least("__cap", F.col("__level") * F.col("__w")).alias("target"))


def _sampled(docs: DataFrame) -> DataFrame:
    """``source, doc_id, size, key`` of every row; what all decisions are made from."""
    sized = docs.select("source", "doc_id", "text", word_count(F.col("text")).alias("size"))
    weight = quality_weight(F.col("text"), F.col("size"))
    return sized.select("source", "doc_id", "size", exponential_key(F.col("doc_id"), weight).alias("key"))


def _steps(key: Column) -> tuple[Column, Column]:
    """A key's place on two levels of equal steps of its distribution function."""
    place = (F.lit(1.0) - F.exp(-key)) * _STEPS
    coarse = F.least(F.floor(place), F.lit(_STEPS - 1))
    return coarse.cast("int"), F.least(F.floor((place - coarse) * _STEPS), F.lit(_STEPS - 1)).cast("int")


def _crossing(sums: DataFrame, step: str) -> DataFrame:
    """Of each source, the step in which the running sum of ``size`` passes the budget, and the budget left there."""
    order = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    found = (F.col("__before") < F.col("budget")) & (F.col("__before") + F.col("size") >= F.col("budget"))
    return running.where(found).select("source", step, (F.col("budget") - F.col("__before")).alias("budget"))


def mix_plan(sampled: DataFrame, **shares) -> DataFrame:
    """One row per source: ``source_size, target, epochs`` and the threshold of the partial epoch.

    Whole epochs come first; the rest of a target is the budget of the partial
    epoch.  Its prefix sum runs over 4096 steps of the key distribution, then
    over 4096 steps of the step where the budget falls, then over the keys of
    that small step, so no window ever holds a source.  Keys equal in all of
    (key, doc_id, size) are taken together.  The prefix ends before the budget
    is passed (at ``cut``); what is left is filled by the one later document
    whose size is nearest to it (``filler``; the first by key, if several are),
    unless nothing brings the source nearer to its target.
    """
    sizes = sampled.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, **shares)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("int"))
    plan = cut_lineage(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    coarse, fine = _steps(F.col("key"))
    stepped = sampled.withColumns({"__coarse": coarse, "__fine": fine}).where(F.col("size") > 0)

    def narrowed(rows: DataFrame, found: DataFrame, step: str) -> DataFrame:
        at = found.select(F.col("source").alias("__source"), F.col(step).alias("__step"), "budget")
        same = F.col("source").eqNullSafe(F.col("__source")) & (F.col(step) == F.col("__step"))
        return rows.drop("budget").join(at, same).drop("__source", "__step")

    def budgeted(sums: DataFrame, budgets: DataFrame) -> DataFrame:
        at = budgets.select(F.col("source").alias("__source"), "budget")
        return sums.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    first = _crossing(budgeted(stepped.groupBy("source", "__coarse").agg(F.sum("size").alias("size")), plan), "__coarse")
    rows = narrowed(stepped, first, "__coarse")
    second = _crossing(rows.groupBy("source", "__fine", "budget").agg(F.sum("size").alias("size")), "__fine")
    rows = narrowed(rows, second, "__fine")

    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    running = _tied(rows, "budget").withColumn("__before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = running.where((F.col("__before") < F.col("budget")) & (F.col("__before") + F.col("words") >= F.col("budget")))
    own = F.struct("key", "doc_id", "size")
    cut = cut_lineage(at.select(F.col("source").alias("__source"), own.alias("cut"), (F.col("budget") - F.col("__before")).alias("left")), "mix-cuts")

    same = F.col("source").eqNullSafe(F.col("__source"))
    beyond = _tied(sampled.where(F.col("size") > 0)).join(cut, same).where(own >= F.col("cut"))
    off = F.abs(F.col("left") - F.col("words"))
    nearest = F.min(F.struct(off.alias("off"), "key", "doc_id", "size")).alias("n")
    fillers = beyond.where(off < F.col("left")).groupBy("__source").agg(nearest)
    fillers = fillers.select("__source", F.struct("n.key", "n.doc_id", "n.size").alias("filler"))

    found = plan.join(cut.drop("left"), same, "left").drop("__source").join(fillers, same, "left")
    return cut_lineage(found.select("source", "source_size", "target", "epochs", "cut", "filler"), "mix-plan")


def _tied(rows: DataFrame, *more: str) -> DataFrame:
    """Rows equal in source, key, id and size as one, with their ``words`` together."""
    return rows.groupBy("source", "key", "doc_id", "size", *more).agg(F.sum("size").alias("words"))


def repeats(key: Column) -> Column:
    """How often a document of a joined plan row is taken: whole epochs, and once more before the cut or as filler."""
    own = F.struct(key.alias("key"), F.col("doc_id"), F.col("size"))
    partial = F.coalesce(own < F.col("cut"), F.lit(False)) | F.coalesce(own.eqNullSafe(F.col("filler")), F.lit(False))
    return F.col("epochs") + (partial & (F.col("size") > 0)).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """How much of each document the mix takes.

    ``doc_id, size, source_size, target, taken, repeats``.  A document without
    words has size 0 and is taken as often as there are whole epochs (0 words).
    A null source is a source of its own, the last.  Rows sharing id, size and
    source are drawn together.  A corpus without words has targets of 0.
    """
    sampled = cut_lineage(_sampled(docs), "mix-sampled")
    plan = mix_plan(sampled)
    at = plan.withColumnRenamed("source", "__source")
    joined = sampled.join(at, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("repeats", repeats(F.col("key"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    plan = mix_plan(cut_lineage(_sampled(docs), "mix-sampled"))
    at = plan.select(F.col("source").alias("__source"), "epochs", "cut", "filler")
    prepared = docs.select(
        F.struct(*docs.columns).alias("__row"),
        F.col("source").alias("__own_source"),
        "doc_id",
        word_count(F.col("text")).alias("size"),
        F.col("text").alias("__text"),
    )
    weight = quality_weight(F.col("__text"), F.col("size"))
    keyed = prepared.withColumn("__key", exponential_key(F.col("doc_id"), weight)).drop("__text")
    joined = keyed.join(at, F.col("__own_source").eqNullSafe(F.col("__source")))
    copies = joined.select("__row", repeats(F.col("__key")).alias("__times")).where(F.col("__times") > 0)
    return copies.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).select("__row.*")
