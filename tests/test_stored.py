"""Audit log, sketches and the timeline of service levels."""

import json

import pytest
from pyspark.sql import functions as F

from opsloom.operators import operations as O
from opsloom.operators import sketches as SK
from opsloom.operators.audit import query_events
from opsloom.streaming import auditlog as AL


def entries(spark, n, start=0, size=40):
    rows = spark.range(start, start + n).select(
        (F.col("id") % 7).alias("session_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp_ntz").alias("ts"),
        F.repeat(F.lit("é"), (F.col("id") % size).cast("int")).alias("message"),
    )
    return query_events(rows)


def test_a_batch_counts_once_and_files_stay_below_the_limit(spark, tmp_path):
    path, limit = str(tmp_path / "log"), 2_000
    assert AL.commit_batch(entries(spark, 300), path, 0, limit)
    assert not AL.commit_batch(entries(spark, 300), path, 0, limit)
    assert AL.commit_batch(entries(spark, 50, 300), path, 1, limit)
    log = AL.read_log(spark, path)
    assert sorted(map(str, log.collect())) == sorted(map(str, entries(spark, 350).collect()))
    files = AL.log_files(spark, path).collect()
    assert len(files) > 50 and max(f.bytes for f in files) <= limit and sum(f.records for f in files) == 350
    # most files are filled: the next record of their day did not fit
    assert sum(f.bytes for f in files) / len(files) > limit / 4


def test_files_above_a_size_are_found_without_the_others(spark, tmp_path):
    path = str(tmp_path / "log")
    assert AL.commit_batch(entries(spark, 120), path, 0, 2_000)
    files = {(f.path, f.bytes, f.records) for f in AL.log_files(spark, path).collect()}
    middle = sorted(f[1] for f in files)[len(files) // 2]
    assert {(f.path, f.bytes, f.records) for f in AL.log_files(spark, path, above=middle).collect()} == {f for f in files if f[1] > middle}
    assert AL.log_files(spark, path, above=2_000).count() == 0


def test_records_above_the_limit_and_broken_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    AL.commit_batch(entries(spark, 20, size=3000).coalesce(1), path, 5, 300)
    files = AL.log_files(spark, path).collect()
    assert all(f.bytes <= 300 or f.records == 1 for f in files) and sum(f.records for f in files) == 20
    broken = entries(spark, 5).withColumn("user_message", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        AL.commit_batch(broken, path, 6)
    assert AL.read_log(spark, path).count() == 20
    assert AL.commit_batch(entries(spark, 5), path, 6) and AL.read_log(spark, path).count() == 25
    assert AL.read_log(spark, str(tmp_path / "none")).collect() == []


def test_replayed_stream(spark, tmp_path):
    """A stream that lost its last commit mark writes that batch again; the log has it once."""
    source, log, marks = (str(tmp_path / n) for n in ("in", "log", "marks"))
    schema = entries(spark, 1).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for at in (0, 40):
        entries(spark, 40, at).coalesce(1).write.mode("append").parquet(source)
        AL.follow(stream, log, marks).awaitTermination()
    for mark in ("1", ".1.crc"):
        (tmp_path / "marks" / "commits" / mark).unlink()
    AL.follow(stream, log, marks).awaitTermination()
    rows = AL.read_log(spark, log)
    assert rows.count() == 80 and len(list((tmp_path / "log" / "commits").glob("*.json"))) == 2
    assert json.loads((tmp_path / "log" / "commits" / "000000000001.json").read_text())["batch"] == 1


EVENTS = "/root/testdata/sf0.01/events.parquet"


def test_quantiles_of_any_range_from_sketches(spark, tmp_path):
    path = str(tmp_path / "hours")
    events = spark.read.parquet(EVENTS)
    SK.store_hours(SK.hourly_sketches(events, "value", ["event_type"], "user_id"), path)
    # a day sent again replaces itself
    SK.store_hours(SK.hourly_sketches(events.where("date(ts) = '2024-01-05'"), "value", ["event_type"], "user_id"), path)
    fractions = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    for since, until in ((None, None), ("2024-01-05 07:00:00", "2024-01-12 19:00:00")):
        rows = events if since is None else events.where(F.col("ts").between(since, until))
        found = SK.merged_quantiles(SK.read_hours(spark, path, since, until), ["event_type"], fractions)
        counts = {r.event_type: r.observations for r in found.collect()}
        assert counts == {r.event_type: r["count"] for r in rows.groupBy("event_type").count().collect()}
        errors = SK.rank_errors(rows, found, "event_type", "value", fractions).collect()
        assert len(errors) == 5 and all(max(r[1:]) <= SK.RANK_ERROR for r in errors)
    days = SK.merged_quantiles(SK.read_hours(spark, path), [F.to_date("hour").alias("day"), "event_type"], fractions)
    assert days.count() == events.select(F.to_date("ts"), "event_type").distinct().count()


def test_quantile_error_of_many_rows(spark):
    rows = spark.range(200_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("value"), F.lit("a").alias("label"), (F.col("id") % 50_000).alias("s"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 360_000).cast("timestamp_ntz").alias("ts"),
    )
    hours = SK.hourly_sketches(rows, "value", ["label"], "s")
    found = SK.merged_quantiles(hours, ["label"], {"p50": 0.5, "p99": 0.99})
    assert max(SK.rank_errors(rows, found, "label", "value", {"p50": 0.5, "p99": 0.99}).first()[1:]) <= SK.RANK_ERROR
    active = SK.sliding_sessions(hours, 200).agg(F.max("active")).first()[0]
    assert abs(active - 50_000) <= 50_000 * 2 ** (1 - SK.THETA_SIZE / 2)


def test_nulls_in_sketches(spark):
    rows = spark.createDataFrame(
        [(None, None, "2024-01-01 00:10:00"), (1.0, 5, "2024-01-01 00:20:00"), (None, None, "2024-01-02 03:00:00")], "value double, user long, at string"
    ).select("value", "user", F.col("at").cast("timestamp_ntz").alias("ts"))
    hours = SK.hourly_sketches(rows, "value", [], "user")
    assert SK.merged_quantiles(hours, [], {"p50": 0.5}).collect() == [(1, 1.0)]
    assert [(str(r.day), r.active, r.returned, r.fresh) for r in SK.daily_sessions(hours).orderBy("day").collect()] == [
        ("2024-01-01", 1, 0, 1), ("2024-01-02", 0, 0, 0),
    ]


def test_timeline_of_levels(spark):
    rows = [
        ("r", "s1", "S", "gold", "2024-01-01 00:30:00", 10.0, False, True),
        ("r", "s1", "S", "gold", "2024-01-01 23:30:00", 40.0, True, True),
        ("r", "s1", "S", "gold", "2024-01-02 00:00:00", 99.0, False, False),
        ("r", "s2", "T", None, "2024-01-02 10:00:00", 29.0, False, True),
    ]
    samples = spark.createDataFrame(rows, "region string, service_id string, service_name string, tier string, at string, latency_ms double, is_error boolean, is_available boolean")
    samples = samples.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    out = O.sla_timeline(samples, O.sla_thresholds(spark), "2024-01-01", "2024-02-03")
    got = {(r.service_id, str(r.as_of)[:10]): r for r in out.collect()}
    assert ("s1", "2024-01-01") not in got and ("s2", "2024-01-02") not in got
    first = got["s1", "2024-01-02"]
    assert (first.current_availability, first.current_latency_ms, first.current_error_rate, first.breach_count_30d) == (100.0, 40.0, 50.0, 1)
    later = got["s1", "2024-01-03"]
    assert (later.current_availability, later.current_latency_ms, later.current_error_rate, later.breach_count_30d) == (66.667, None, 0.0, 2)
    assert not first.is_compliant and got["s2", "2024-01-03"].is_compliant
    gone = got["s1", "2024-02-02"]
    assert (gone.current_availability, gone.breach_count_30d, gone.is_compliant) == (None, 0, True)


def _many_sessions(spark):
    """40,000 sessions on each of two days, half of those of the second day new, each seen in several hours; some rows without session or time."""
    rows = spark.range(240_000).select(
        (F.col("id") % 40_000 + F.when(F.col("id") < 120_000, 0).otherwise(20_000)).alias("s"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") >= 120_000).cast("long") * 86_400 + F.pmod(F.xxhash64("id"), F.lit(86_400))).cast("timestamp_ntz").alias("ts"),
    )
    odd = spark.createDataFrame([(None, "2024-01-01 05:00:00"), (7, None), (7, None)], "s long, at string").select("s", F.col("at").cast("timestamp_ntz").alias("ts"))
    return rows.unionByName(odd)


def test_more_sessions_a_day_than_a_sketch_holds(spark, tmp_path):
    path = str(tmp_path / "sessions")
    rows = _many_sessions(spark)
    SK.store_hours(SK.hourly_sessions(rows, "s"), path)
    # a day sent again replaces itself
    SK.store_hours(SK.hourly_sessions(rows.where("date(ts) = '2024-01-02'"), "s"), path)
    days = SK.exact_daily_sessions(SK.read_hours(spark, path)).orderBy("day").collect()
    assert [(r.day and str(r.day), r.active, r.returned, r.fresh) for r in days] == [
        (None, 1, 0, 1), ("2024-01-01", 40_000, 0, 40_000), ("2024-01-02", 40_000, 20_000, 20_000),
    ]


def test_windows_of_more_sessions_than_a_sketch_holds(spark):
    rows = _many_sessions(spark)
    found = {r.window_end and str(r.window_end): r.active for r in SK.exact_sliding_sessions(SK.hourly_sessions(rows, "s"), 30).collect()}
    hours = rows.where("s IS NOT NULL").select("s", F.date_trunc("hour", "ts").alias("h")).distinct()
    spread = hours.select("s", "h", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n"))
    ends = spread.groupBy((F.col("h") + F.make_dt_interval(F.lit(0), F.col("n"))).cast("timestamp_ntz").alias("e")).agg(F.count_distinct("s").alias("n"))
    assert found == {r.e and str(r.e): r.n for r in ends.collect()}
    assert max(found.values()) > 2 ** SK.THETA_SIZE
