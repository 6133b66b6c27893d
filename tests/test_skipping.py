"""Searches that skip: the same rows as full scans, and less read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import blockmax as BM
from opsloom.operators import retrieval as R
from opsloom.operators import vector_index as VI


def texts(spark, n=2500):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        body = draw.choices(words, weights=[1 / (1 + r) for r in range(40)], k=draw.randint(1, 60))
        rows.append((i, " ".join(body + ["rare"] * (draw.randint(5, 9) if i % 500 == 3 else 0) + ["common"])))
    return spark.createDataFrame(rows + [(n, None), (n + 1, "")], "doc long, content string")


def test_block_max_equals_scan_and_reads_less(spark, tmp_path):
    corpus = texts(spark).cache()
    path = str(tmp_path / "index")
    BM.write_index(corpus.repartition(6), path, "doc", block_bits=5)
    for terms, k in ((["rare", "common"], 3), (["w0", "w1", "w7"], 5), (["W39", "w39", "none"], 4), (["common"], 2), (["w2"], 5000)):
        got, counter = BM.top_k(spark, path, terms, k, "doc")
        wanted = R.bm25_top_k(corpus, terms, k, "doc")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())), terms
        assert counter["read"] <= counter["of"]
        if terms == ["rare", "common"]:
            assert counter["read"] < counter["of"] / 3, counter
    got, counter = BM.top_k(spark, path, ["nobody", "says"], 5, "doc")
    assert got.collect() == [] and counter["of"] == 0


def clustered(spark, n=3000, width=16):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((12, width)) * 4
    rows = [(i, (centres[i % 12] + draw.standard_normal(width) * 0.4).tolist(), "ab"[i % 2]) for i in range(n)]
    rows += [(n, [0.0] * width, "a"), (n + 1, None, "a"), (n + 2, [1.0, 2.0], "b"), (n + 3, [float("nan")] * width, "b"), (n + 4, rows[0][1], "a")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string"), [r[1] for r in rows]


def test_vector_index_equals_scan_and_reads_less(spark, tmp_path):
    corpus, vectors = clustered(spark)
    path = str(tmp_path / "index")
    VI.write_index(corpus.repartition(5), path, "vec_id")
    usable = corpus.where("vec_id <> 3003")
    for probe, k in ((vectors[0], 10), (vectors[7], 1), (vectors[4], 400), ([1.0, 1.0], 3), ([0.0] * 16, 4)):
        got, counter = VI.top_k(spark, path, probe, k, "vec_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.vector_top_k(usable, probe, k, "vec_id").collect()))
        if k == 10:
            assert counter["rows"] < counter["of_rows"] / 3 and counter["lists"] < counter["of_lists"], counter
    got, _ = VI.top_k(spark, path, vectors[1], 6, "vec_id", where=F.col("kind") == "a")
    wanted = R.vector_top_k(usable.where("kind = 'a'"), vectors[1], 6, "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_vector_index_without_directions(spark, tmp_path, rows):
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    VI.write_index(corpus, str(tmp_path / "i"), "vec_id")
    got, _ = VI.top_k(spark, str(tmp_path / "i"), [1.0, 0.0], 3, "vec_id")
    assert got.collect() == R.vector_top_k(corpus, [1.0, 0.0], 3, "vec_id").collect()
