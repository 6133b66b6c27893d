"""Hilbert curve and shards against direct checks."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

import corpora
from opsloom.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"c{i}" for i in range(dims)]
    rows = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    at = {r.h: tuple(r[n] for n in names) for r in rows.withColumn("h", hilbert.hilbert_index([F.col(n) for n in names], bits)).collect()}
    assert sorted(at) == list(range(len(cells)))
    steps = [sum(abs(x - y) for x, y in zip(at[i], at[i + 1])) for i in range(len(cells) - 1)]
    assert set(steps) == {1}


def check(out, rows, shards):
    assert len(out) == len(rows)
    counts = [0] * shards
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        assert r.slot == counts[r.shard]
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    got = sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str)
    assert got == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert {r.law for r in out} <= {"rows"} and all(r.grown_shard is None for r in out)
    placed = [r.hilbert for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert placed == sorted(placed)


def test_awkward_rows(spark):
    check(hilbert.shard_documents(corpora.documents(spark)).collect(), [(r[0], r[1]) for r in corpora.rows()], 24)


def test_one_cell_with_all_rows_is_cut(spark):
    rows = [(i, "the same text", "en", "s") for i in range(1000)]
    out = hilbert.shard_documents(corpora.table(spark, *rows).repartition(5), 7).collect()
    check(out, [(i, t) for i, t, _, _ in rows], 7)


def test_equal_texts_of_a_cell_follow_each_other(spark):
    rows = [(i, f"text {i % 10}", "en", "s") for i in range(400)]
    out = sorted(hilbert.shard_documents(corpora.table(spark, *rows), 8).collect(), key=lambda r: (r.shard, r.slot))
    runs = [k for k, _ in itertools.groupby(out, key=lambda r: (r.hilbert, r.text_crc32))]
    assert len(runs) == len(set(runs))


def test_shards_span_small_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharded = hilbert.shard_documents(docs).join(docs.drop("text"), "doc_id")
    spans = hilbert.shard_ranges(sharded, ["source", "lang", "size"]).collect()
    # a filter on one source reads far fewer shards than there are
    sources = [r.source for r in docs.select("source").distinct().collect()]
    read = [sum(s.min_source <= x <= s.max_source for s in spans) for x in sources]
    assert sum(read) / len(read) < 12


@pytest.mark.parametrize("few", [hilbert.FEW_NAMES, 1])
def test_sources_that_begin_alike_lie_apart(spark, monkeypatch, few):
    monkeypatch.setattr(hilbert, "FEW_NAMES", few)
    rows = [(i, f"text {i}", "en", None if i % 50 == 0 else "common_crawl_" + "ab"[i % 2]) for i in range(400)]
    out = hilbert.shard_documents(corpora.table(spark, *rows), 4).collect()
    check(out, [(i, t) for i, t, _, _ in rows], 4)
    source = {r[0]: r[3] for r in rows}
    held = [{source[r.doc_id] for r in out if r.shard == k} - {None} for k in range(4)]
    assert sum(len(h) for h in held) <= 5


def test_name_ranks(spark):
    names = ["b", "a", None, "a", "", "Z", "é", "\U0001f600", "\uffee"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.value for r in sorted(hilbert.name_ranks(rows, "name").collect(), key=lambda r: r.place)]
    assert got == sorted({n for n in names if n is not None})


def test_empty_table(spark):
    assert hilbert.shard_documents(corpora.no_documents(spark)).collect() == []
