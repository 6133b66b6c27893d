"""Stored sketches an hour and label set: quantiles and distinct sessions of any range without its rows.

Sketches are small, bounded and mergeable: quantiles by KLL (a rank is off by
at most ``RANK_ERROR`` with 99 % confidence), distinct counts and their set
operations by theta sketches (exact below ``2 ** THETA_SIZE`` distinct values,
off by about ``2 ** (1 - THETA_SIZE / 2)`` above, two standard errors).
Where counts must be exact at any size, the sessions of each hour are stored
beside them, each once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: size of a KLL sketch, and the rank error that goes with it
KLL_SIZE = 400
RANK_ERROR = 0.007
#: a theta sketch keeps up to two to this power hashes
THETA_SIZE = 14


def hourly_sketches(rows: DataFrame, value: str, labels: Sequence[str], session: str, ts: str = "ts") -> DataFrame:
    """``hour, labels, observations, quantiles, sessions``: one row an hour and label set, pre-aggregated before the shuffle.

    Null values are no observations and null sessions none; an hour without
    rows has no row.
    """
    return rows.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), *labels).agg(
        F.count(value).alias("observations"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("quantiles"),
        F.theta_sketch_agg(session, THETA_SIZE).alias("sessions"),
    )


def hourly_sessions(rows: DataFrame, session: str, ts: str = "ts") -> DataFrame:
    """``hour, session``: the sessions of each hour, each once, for :func:`store_hours`; null sessions are none.

    A task gets hours as a whole where they fit, so a day is few files.
    """
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")
    seen = rows.where(F.col(session).isNotNull()).select(hour, F.col(session).alias("session"))
    return seen.distinct().hint("rebalance", "hour")


def store_hours(sketches: DataFrame, path: str) -> None:
    """Write hourly sketches, a folder a day; the days written are replaced as a whole, so a day may be sent again."""
    days = sketches.withColumn("day", F.to_date("hour"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_hours(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored sketches of the hours from ``since`` to before ``until``; only folders of their days are opened."""
    rows = spark.read.parquet(path)
    if since is not None:
        at = F.lit(since).cast("timestamp_ntz")
        rows = rows.where((F.col("hour") >= at) & (F.col("day") >= F.to_date(at)))
    if until is not None:
        at = F.lit(until).cast("timestamp_ntz")
        rows = rows.where((F.col("hour") < at) & (F.col("day") <= F.to_date(at)))
    return rows


def merged_quantiles(sketches: DataFrame, keys: Sequence[str | Column], fractions: dict[str, float]) -> DataFrame:
    """Quantiles of all hours of each group of ``keys`` (labels, days, months), by merging sketches: keys, observations, one column a name."""
    merged = sketches.where("observations > 0").groupBy(*keys).agg(
        F.sum("observations").alias("observations"), F.kll_merge_agg_double("quantiles").alias("__q")
    )
    own = [c for c in merged.columns if not c.startswith("__")]
    return merged.select(*own, *[F.kll_sketch_get_quantile_double("__q", F.lit(f)).alias(n) for n, f in fractions.items()])


def rank_errors(rows: DataFrame, quantiles: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """How far the quantiles of each key lie from their rank among all rows: ``key`` and ``error_<name>``.

    A value holds all ranks between the shares of smaller and of not larger
    rows; the error is the distance from that interval.
    """
    table = quantiles.select(key, *fractions)
    joined = rows.where(F.col(value).isNotNull()).join(F.broadcast(table), key)  # a row a label
    shares = joined.groupBy(key).agg(
        *[F.avg((F.col(value) < F.col(n)).cast("double")).alias(f"__below_{n}") for n in fractions],
        *[F.avg((F.col(value) <= F.col(n)).cast("double")).alias(f"__upto_{n}") for n in fractions],
    )
    error = {n: F.greatest(F.lit(0.0), F.col(f"__below_{n}") - f, F.lit(f) - F.col(f"__upto_{n}")) for n, f in fractions.items()}
    return shares.select(key, *[e.alias(f"error_{n}") for n, e in error.items()])


def daily_sessions(sketches: DataFrame) -> DataFrame:
    """``day, active, returned, fresh``: estimated sessions of a day, those also seen the day before, and those not.

    Works on one row an hour: hours are united to days, and a day meets the
    day before by set operations on sketches.
    """
    days = sketches.groupBy(F.to_date("hour").alias("day")).agg(F.theta_union_agg("sessions", THETA_SIZE).alias("__s"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("__s").alias("__b"))
    both = days.join(before, "day", "left")
    known = F.theta_sketch_estimate(F.theta_intersection("__s", "__b"))
    fresh = F.theta_sketch_estimate(F.theta_difference("__s", "__b"))
    active = F.theta_sketch_estimate("__s")
    return both.select(
        "day", active.alias("active"), F.coalesce(known, F.lit(0)).alias("returned"), F.coalesce(fresh, active).alias("fresh")
    )


def sliding_sessions(sketches: DataFrame, hours: int) -> DataFrame:
    """``window_end, active``: estimated sessions of the ``hours`` hours before each full hour within the range of the data.

    Each hour's sketch goes to the windows it belongs to, so work grows with
    hours, not with rows.
    """
    hourly = sketches.groupBy("hour").agg(F.theta_union_agg("sessions", THETA_SIZE).alias("sessions"))
    ends = F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("__n")
    spread = hourly.select("sessions", "hour", ends).withColumn("window_end", F.col("hour") + F.make_dt_interval(F.lit(0), F.col("__n")))
    return spread.groupBy("window_end").agg(F.theta_sketch_estimate(F.theta_union_agg("sessions", THETA_SIZE)).alias("active"))


def exact_daily_sessions(sessions: DataFrame) -> DataFrame:
    """:func:`daily_sessions` without error at any size, from :func:`hourly_sessions`.

    A session tells its own day and the day after, so one grouping decides both
    and days meet nowhere else.
    """
    days = sessions.select(F.to_date("hour").alias("day"), "session").distinct()
    told = F.explode(F.array(F.struct(F.col("day"), F.lit(True).alias("today")), F.struct(F.date_add("day", 1).alias("day"), F.lit(False).alias("today"))))
    # sessions without a time are of no day, and no day follows them
    kept = days.select("session", told.alias("t")).select("session", "t.*").where(F.col("day").isNotNull() | F.col("today"))
    each = kept.groupBy("day", "session").agg(F.bool_or("today").alias("__now"), F.bool_or(~F.col("today")).alias("__back")).where("__now")
    counts = each.groupBy("day").agg(F.count("*").alias("active"), F.count_if("__back").alias("returned"))
    return counts.withColumn("fresh", F.col("active") - F.col("returned"))


def exact_sliding_sessions(sessions: DataFrame, hours: int) -> DataFrame:
    """:func:`sliding_sessions` without error at any size, from :func:`hourly_sessions`.

    A session counts in the windows from each of its hours up to its next hour,
    so in every window once, and what is counted is a number a window.
    """
    following = F.lead("hour").over(Window.partitionBy("session").orderBy("hour"))
    gap = F.timestamp_diff("HOUR", F.col("hour"), F.col("__next")).cast("int")
    upto = F.when(F.col("hour").isNull(), 1).otherwise(F.least(F.lit(hours), F.coalesce(gap, F.lit(hours))))
    once = sessions.select("hour", "session").distinct().withColumn("__next", following)
    spread = once.select("hour", F.explode(F.sequence(F.lit(1), upto)).alias("__n"))
    return spread.groupBy((F.col("hour") + F.make_dt_interval(F.lit(0), F.col("__n"))).alias("window_end")).agg(F.count("*").alias("active"))
