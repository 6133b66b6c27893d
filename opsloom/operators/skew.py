"""Joins and look-backs that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.text import let

#: a key is hot when it holds more than one row in HOT_SHARE, so there are fewer than HOT_SHARE
HOT_SHARE = 1000
#: and a key with fewer rows than this is no burden to one task
HOT_ROWS = 100_000


def explode_rows(rows: DataFrame, keep: list[str], items: Column | str, index: str, element: str) -> DataFrame:
    """One row per array element with its position; rows without elements disappear.

    The outer form keeps the optimizer from inferring a filter on the array's
    size, which would evaluate a costly array twice.
    """
    return rows.select(*keep, F.posexplode_outer(items).alias(index, element)).where(F.col(index).isNotNull())


def hot_keys(
    rows: DataFrame, keys: str | list[str], share: int = HOT_SHARE, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Keys of ``rows`` that hold more than 1/1000 of all rows (and many): at most 999 of them.

    The count is pre-aggregated before its shuffle, so finding a hot key costs
    no more than finding a cold one.
    """
    keys = [keys] if isinstance(keys, str) else keys
    known = rows
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    counts = known.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("total")).scalar()
    return counts.where((F.col("__n") > min_rows) & (F.col("__n") * share > total)).select(*keys)


def _found(hot: DataFrame) -> DataFrame | None:
    """Hot keys, looked for once: fewer than ``share`` rows as a table of literals, or None where there are none."""
    keys = hot.collect()
    return hot.sparkSession.createDataFrame(keys, hot.schema) if keys else None


def lookup(
    rows: DataFrame, table: DataFrame, key: str, columns: list[str], min_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join ``rows`` with a stored ``table`` (unique ``key``) for ``columns``.

    Rows of hot keys get their values from a broadcast of just those keys'
    entries (fewer than 1000 by construction).  Their shuffle key is then
    replaced by a spread-out one that matches nothing, so that the shuffled
    join only carries an even load.  Null keys are spread the same way.
    """
    hashable = [name for name, dtype in rows.dtypes if "map<" not in dtype and "variant" not in dtype]
    spread = F.concat(F.lit("\x00:"), F.xxhash64(*hashable).cast("string"))
    cold = table.select(F.col(key).cast("string").alias("__cold_key"), F.struct(*columns).alias("__cold"))
    found = _found(hot_keys(rows, key, min_rows=min_rows))
    if found is None:
        staged = rows.withColumn("__join_key", F.coalesce(F.col(key).cast("string"), spread))
        values = F.col("__cold")
    else:
        hot = table.join(F.broadcast(found), key, "left_semi")
        hot = hot.select(F.col(key).alias("__hot_key"), F.struct(*columns).alias("__hot"))
        staged = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn(
            "__join_key",
            F.when(F.col("__hot_key").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread),
        )
        values = F.when(F.col("__hot_key").isNotNull(), F.col("__hot")).otherwise(F.col("__cold"))
    joined = staged.join(cold, F.col("__join_key") == F.col("__cold_key"), "left")
    return joined.select(*rows.columns, *[values[c].alias(c) for c in columns])


_BLOCK = 32


def _bounds_below(at: Column) -> Column:
    """How many of the sorted ``__bounds`` lie below ``at``: whole blocks first, then within one block."""
    blocks = F.size(F.filter("__blocks", lambda b: b < at)) * _BLOCK
    return let(blocks, lambda n: n + F.size(F.filter(F.slice("__bounds", n + 1, F.lit(_BLOCK)), lambda b: b < at)))


def lookback(
    rows: DataFrame,
    keys: list[str],
    order: str,
    payload: Column,
    n: int,
    output: str = "recent",
    share: int = HOT_SHARE,
    cuts: int = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the payloads of the ``n`` rows before each row of its group, oldest first.

    ``order`` is a number or a time stamp, unique within a group.  A plain
    window would pull a whole group into one task.  Here each hot group (there
    are fewer than ``share``) is cut at its own quantiles into ``cuts``
    stretches of about equal size, and every stretch is handed the last ``n``
    payloads of the stretches before it:

    1. quantiles of each hot group, as mergeable sketches;
    2. the last ``n`` rows of each stretch, by a limited window;
    3. per hot group one small row per stretch, from which each stretch's
       hand-over is collected (any ``n`` earlier stretches hold enough rows);
    4. the plain window over ``(group, stretch)``.

    Other groups are one stretch.  Hot groups are looked for first, by a
    pre-aggregated count; without any, the plain window is all there is.
    """
    found = _found(hot_keys(rows, keys, share, min_rows))
    if found is None:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
        return rows.withColumn(output, F.collect_list(payload).over(before))
    dtype = dict(rows.dtypes)[order]
    position = F.col(order)
    if dtype.startswith("timestamp"):
        position = F.unix_micros(position.cast("timestamp"))
    base = rows.withColumn("__at", position)
    hot = F.broadcast(found)
    fractions = F.expr("array(" + ", ".join(f"{i / cuts}D" for i in range(1, cuts)) + ")")
    bounds = (
        base.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_distinct(F.percentile_approx("__at", fractions, 10 * cuts)).alias("__bounds"))
        .withColumn("__blocks", F.filter("__bounds", lambda b, i: i % _BLOCK == _BLOCK - 1))
    )
    # at most `share` rows of `cuts` numbers
    at = F.col("__at")
    base = (
        base.join(F.broadcast(bounds), keys, "left")
        .withColumn("__payload", payload)
        .withColumn("__stretch", F.coalesce(_bounds_below(at), F.lit(0)))
    )
    stretch_keys = [*keys, "__stretch"]

    newest = Window.partitionBy(*stretch_keys).orderBy(F.col("__at").desc())
    tails = (
        base.where(F.col("__bounds").isNotNull())
        .select(*stretch_keys, "__at", "__payload")
        .withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") <= n)
        .groupBy(*stretch_keys)
        .agg(F.collect_list(F.struct("__at", "__payload")).alias("__tails"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(-n, -1)
    held = F.flatten(F.collect_list("__tails").over(earlier))
    newest_first = F.array_sort(
        held, lambda x, y: F.when(x["__at"] > y["__at"], -1).when(x["__at"] < y["__at"], 1).otherwise(0)
    )
    halo = (
        tails.select(*stretch_keys, F.slice(newest_first, 1, n).alias("__handed"))
        .select(*stretch_keys, F.inline("__handed"))
        .withColumn("__halo", F.lit(True))
    )
    merged = base.drop("__bounds", "__blocks").withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    before = Window.partitionBy(*stretch_keys).orderBy("__at").rowsBetween(-n, -1)
    return (
        merged.withColumn(output, F.collect_list("__payload").over(before))
        .where(~F.col("__halo"))
        .drop("__stretch", "__payload", "__halo", "__at")
    )
