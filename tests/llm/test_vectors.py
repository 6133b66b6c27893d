"""Vector searches against brute force over all pairs."""

import math

import numpy as np
import pytest

from opsloom.llm import ann, exact_topk


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, list string, block int")


def good(v, zeros):
    if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
        return False
    return zeros or any(v)


def plain_product(a, b):
    """Component by component; sum() would add more exactly."""
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def brute_ann(rows, queries, k=20):
    usable = [(i, v) for i, v in rows if i is not None and good(v, False)]
    out = {}
    for q, w in usable:
        if q in queries:
            scored = sorted((-plain_product(w, v), i) for i, v in usable if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_ann_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    queries = {i for i, _ in rows if i % 20 == 0}
    got = found(ann.search(table, table.where("vec_id % 20 = 0")))
    want = brute_ann(rows, queries)
    assert set(got) == queries and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.9 * 20 * len(queries)
    by_id = dict(rows)
    for q in list(queries)[:20]:
        for i, score in got[q]:
            assert score == plain_product(by_id[q], by_id[i])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_ann_with_very_different_lengths(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.standard_normal(12) * 10.0 ** draw.integers(-2, 3)).tolist()) for i in range(3000)]
    got = found(ann.search(vectors(spark, rows), vectors(spark, rows[:60])))
    want = brute_ann(rows, {i for i, _ in rows[:60]})
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


AWKWARD = [
    (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []),
    (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.5]), (10, [1.0, 2.0, 3.0]), (20, [3.0, 4.0]),
]


def test_ann_of_awkward_rows(spark):
    rows = vectors(spark, AWKWARD)
    got = found(ann.search(rows, rows.where("vec_id % 20 = 0")))
    assert got[0] == [(20, 3.0), (1, 1.0), (2, 1.0), (2, 1.0), (9, -1.0)]
    assert [i for i, _ in got[20]] == [0, 1, 2, 2, 9]
    assert found(ann.search(rows.limit(0), rows)) == {} and found(ann.search(rows, rows.limit(0))) == {}


def test_ann_with_a_third_of_equal_vectors(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [1.0] + [0.0] * 7 if i % 3 == 0 else draw.standard_normal(8).tolist()) for i in range(3000)]
    got = found(ann.search(vectors(spark, rows).repartition(7), vectors(spark, [rows[0], rows[30]])))
    want = brute_ann(rows, {0, 30})
    # ties in order of their ids
    assert [i for i, s in got[0] if s == 1.0] == [i for i, s in want[0] if s == 1.0]
    assert len(got[30]) == 20


def brute_exact(rows, queries, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and good(v, True)]
    out = {}
    for q, w in usable:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_exact_of_the_tables(spark, name):
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert found(exact_topk.search(table, table.where("vec_id % 50 = 0"))) == brute_exact(rows, {i for i, _ in rows if i % 50 == 0})


def test_exact_in_many_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "QUERIES", 16)
    draw = np.random.default_rng(6)
    rows = [(i, [0.5] * 20 if i % 3 == 0 else draw.integers(-2, 3, 20).astype(float).tolist()) for i in range(900)]
    got = found(exact_topk.search(vectors(spark, rows), vectors(spark, rows[::9])))
    assert got == brute_exact(rows, {i for i, _ in rows[::9]})


def test_exact_of_awkward_rows(spark):
    rows = vectors(spark, AWKWARD)
    got = found(exact_topk.search(rows, rows.where("vec_id % 20 = 0")))
    assert got[0] == [(20, 196608), (1, 65536), (2, 65536), (2, 65536), (3, 0)]
    assert found(exact_topk.search(rows.limit(0), rows)) == {}


def test_exact_beyond_double_precision(spark):
    draw = np.random.default_rng(7)
    rows = [(i, (draw.standard_normal(4) * 1e6).tolist()) for i in range(200)]
    assert found(exact_topk.search(vectors(spark, rows), vectors(spark, rows[:20]))) == brute_exact(rows, set(range(20)))


def test_bounds_drop_candidates_but_no_winner():
    draw = np.random.default_rng(3)
    columns = draw.integers(-50, 50, (64, 500)).astype(float)
    columns[:, :250] *= 0.01
    columns = np.floor(columns)
    query = columns[:, 400]
    kept, scores = exact_topk.bounded_top(query, exact_topk._norms_behind(query[:, None])[:, 0], np.zeros(500, bool), columns, exact_topk._norms_behind(columns), 5)
    full = query @ columns
    assert len(kept) < 50 and set(np.argsort(-full, kind="stable")[:5]) <= set(kept) and (full[kept] == scores).all()


@pytest.mark.parametrize("search", [ann.search, exact_topk.search])
def test_queries_whose_own_frequent_width_differs(spark, search):
    rows = [(i, [1.0 + i, 2.0]) for i in range(1, 12)] + [(20, [3.0, 4.0]), (100, [5.0, 1.0]), *((i, [1.0, 2.0, 3.0]) for i in (40, 60, 80))]
    table = vectors(spark, rows)
    got = found(search(table, table.where("vec_id % 20 = 0")))
    assert set(got) == {20, 100} and len(got[20]) == (12 if search is ann.search else 5)
