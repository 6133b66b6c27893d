from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opsloom.operators.skew import hot_keys, lookback, lookup


def _brute(rows, n):
    groups = defaultdict(list)
    for s, t, v in rows:
        groups[s].append((t, v))
    out = {}
    for s, items in groups.items():
        items.sort()
        for i, (t, _) in enumerate(items):
            out[(s, t)] = [v for _, v in items[max(0, i - n) : i]]
    return out


@pytest.mark.parametrize("share, cuts", [(1000, 1000), (1000, 7), (4, 50), (4, 150), (4, 2), (1, 10)])
def test_lookback_equals_plain_window(spark, share, cuts):
    # one session holds most rows; gaps leave empty stretches
    rows = [("hot", t * (1 + t % 3), f"h{t}") for t in range(0, 400, 2)]
    rows = list({(s, t): (s, t, v) for s, t, v in rows}.values())
    rows += [(f"s{i}", t * 7, f"{i}-{t}") for i in range(20) for t in range(i % 6)]
    df = spark.createDataFrame(rows, "s string, t int, v string")
    got = {(r.s, r.t): r.recent for r in lookback(df, ["s"], "t", F.col("v"), 4, share=share, cuts=cuts, min_rows=0).collect()}
    assert got == _brute(rows, 4)


def test_lookback_by_time(spark):
    df = spark.sql("SELECT 'a' AS s, timestamp_ntz'2024-01-01' + make_dt_interval(0, id * 5) AS t, id AS v FROM range(50)")
    got = {r.v: r.recent for r in lookback(df, ["s"], "t", F.col("v"), 3, cuts=9, min_rows=0).collect()}
    assert got == {i: list(range(max(0, i - 3), i)) for i in range(50)}


def test_lookup_with_hot_and_null_keys(spark):
    rows = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
    )
    dim = spark.range(700).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).unionAll(spark.sql("SELECT 'hot', -1L"))
    assert "hot" in {r.k for r in hot_keys(rows, "k", min_rows=0).collect()}
    got = sorted(map(tuple, lookup(rows, dim, "k", ["v"], min_rows=0).collect()), key=str)
    plain = rows.join(dim, "k", "left").select("id", "k", "v")
    assert got == sorted(map(tuple, plain.collect()), key=str)


def test_hot_keys_are_few(spark):
    rows = spark.range(100_000).select((F.col("id") % 5000).alias("k"))
    assert hot_keys(rows, "k", min_rows=0).count() == 0
    rows = spark.range(1000).select(F.col("id").alias("k"))
    assert hot_keys(rows, "k", min_rows=0).count() <= 999 and hot_keys(rows, "k", share=1).count() == 0
