import pytest
from pyspark.sql import functions as F

from opsloom.operators import metrics as M
from opsloom.streaming import events as X
from opsloom.streaming.cache import cached_reads


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", v) for v in (0.05, 0.1, 0.3, 99.0)] + [("b", None)], "e string, v double")
    rows = {r.le: r for r in M.histogram(df, "v", [0.1, 0.5, 30.0], ["e"]).collect()}
    assert [rows[b].bucket_count for b in (0.1, 0.5, 30.0, None)] == [2, 3, 3, 4]
    assert rows[None].observations == 4 and rows[None].total == pytest.approx(99.45)
    assert M.histogram(df, "v", [1.0]).count() == 2


def test_tokens(spark):
    df = spark.createDataFrame([(10, None, None), (5, 2, None), (7, 0, 0)], "tokens int, prompt_tokens int, completion_tokens int")
    assert {r.type: r.value for r in M.token_counter(df).collect()} == {"prompt": 2, "total": 17}


def test_gauges_and_quantiles(spark):
    df = spark.range(1, 1001).select((F.col("id") % 7).alias("session_id"), F.col("id").cast("double").alias("v"), F.col("id").alias("ts"))
    assert M.active_sessions(df).first()[0] == 7
    assert M.active_sessions(df, since=F.lit(1000)).first()[0] == 1
    q = M.latency_quantiles(df, "v").first()
    assert (q.p50, q.p95, q.p99) == (500.0, 950.0, 990.0)
    assert M.counter(df, ["session_id"]).agg(F.sum("value")).first()[0] == 1000
    assert M.grounding_failures(df.select((F.col("v") > 10).alias("is_grounded"))).first()[0] == 10
    methods = df.groupBy(M.request_method(F.lit("POST"), F.col("v") > 999).alias("m")).count().collect()
    assert {r.m: r["count"] for r in methods} == {"POST": 999, "POST_ERROR": 1}
    assert M.knowledge_base_size(df).first()[0] == 1000


@pytest.fixture
def source(spark, tmp_path):
    df = spark.sql(
        "SELECT timestamp'2024-01-01' + make_dt_interval(0, 0, id * 7) AS ts, id, id % 3 AS session_id, id % 2 AS kind, id * 1.5D AS value FROM range(200)"
    )
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def _closed(batch, column, df, delay):
    limit = df.agg(F.max("ts")).first()[0]
    return batch.where(F.col(column) <= F.lit(limit) - F.expr(f"INTERVAL {delay}"))


def test_stream_windows_equal_batch(source):
    df, stream = source
    out = X.run_available(X.windowed_counts(stream, ["kind"], "1 hour", value="value"), "w")
    batch = X.windowed_counts(df, ["kind"], "1 hour", value="value")
    wanted = _closed(batch.withColumn("e", F.col("window_start") + F.expr("INTERVAL 1 HOUR")), "e", df, "10 MINUTES").drop("e")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, wanted.collect())) and out.count() > 40


def test_sliding_windows(source):
    df, _ = source
    rows = X.windowed_counts(df, [], "1 hour", "30 minutes").collect()
    assert sum(r.events for r in rows) == 400


def test_stream_sessions_equal_batch(source):
    df, stream = source
    out = X.run_available(X.session_activity(stream, gap="20 minutes"), "s")
    wanted = _closed(X.session_activity(df, gap="20 minutes"), "ended", df, "10 MINUTES")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, wanted.collect())) and out.count() > 100


def test_stream_dedupe(source):
    df, stream = source
    twice = stream.select("id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = X.run_available(X.first_arrivals(twice, ["id"], "30 days"), "d")
    assert sorted(r.id for r in out.collect()) == list(range(200))


def test_audit_stream(spark, tmp_path):
    from opsloom.operators.audit import append_audit, query_events

    base = spark.sql("SELECT 's' AS session_id, timestamp_ntz'2024-03-01' AS ts, 'hi' AS message FROM range(5)")
    append_audit(query_events(base), str(tmp_path / "a"))
    out = X.run_available(X.audit_stream(spark, str(tmp_path / "a")), "audit")
    assert out.count() == 5


def test_cached_reads_expire(spark, tmp_path):
    rows = [
        (1, "a", 0, True, "x"), (2, "a", 5, False, None), (3, "a", 60, False, None), (4, "a", 61, True, "y"), (5, "a", 61, False, None),
        (6, "b", 1, False, None), (7, "b", 2, True, "z"), (8, "b", 61, False, None), (9, "b", 62, False, None),
    ]
    df = spark.createDataFrame(rows, "id long, k string, s long, put boolean, v string").select("*", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = X.run_available(cached_reads(stream, "k", "v", "put", 60, ["id"]), "cached", rocksdb=True)
    assert {r.id: r.cached for r in out.collect()} == {2: "x", 3: None, 5: "y", 6: None, 8: "z", 9: None}


@pytest.mark.parametrize("frame_rows", [7, 10_000])
def test_cache_of_a_hot_key_over_several_batches(spark, tmp_path, frame_rows):
    """A third of all rows under one key, in frames of a few rows, in no order, over several micro-batches."""
    import random

    draw = random.Random(6)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{draw.randrange(20)}"
        rows.append((i, key, i * 7 + draw.randrange(5), draw.random() < 0.3, f"v{i}"))
    wanted, held = {}, {}
    for i, key, at, put, value in sorted(rows, key=lambda r: (r[2], not r[3], r[0])):
        if put:
            held[key] = (at, value)
        else:
            wanted[i] = held[key][1] if key in held and at - held[key][0] < 60 else None
    # puts of one moment under one key would leave the winner open
    assert len({(r[1], r[2]) for r in rows if r[3]}) == sum(r[3] for r in rows)
    path = str(tmp_path / "in")
    schema = "id long, k string, s long, put boolean, v string"
    for part in range(3):
        own = rows[part * 300 : (part + 1) * 300]
        df = spark.createDataFrame(draw.sample(own, 300), schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, frame_rows)
        out = X.run_available(cached_reads(stream, "k", "v", "put", 60, ["id"], slice_seconds=50), "hot-cache", rocksdb=True)
        got = [(r.id, r.cached) for r in out.collect()]
    finally:
        spark.conf.set(name, before)
    assert dict(got) == wanted and len(got) == len(wanted)
