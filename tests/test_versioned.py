"""Versioned collections: linear hashing, atomic versions, and the cache kept in one."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators import embedding as E
from opsloom.operators import versioned as V

CHUNK = "chunk_id string, document_id string, content string"


def chunks(spark, ids, content="old"):
    return spark.createDataFrame([(f"c{i}", f"d{i // 4}", content) for i in ids], CHUNK)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("before, after", [(1, 2), (1, 9), (3, 4), (4, 7), (5, 11), (8, 8)])
def test_only_split_buckets_lose_rows(spark, before, after):
    at = spark.range(2000).select(V.bucket_of(F.col("id"), before).alias("a"), V.bucket_of(F.col("id"), after).alias("b"))
    moved = {(r.a, r.b) for r in at.distinct().collect()}
    assert {b for _, b in moved} == set(range(after)) and {a for a, _ in moved} == set(range(before))
    assert {a for a, b in moved if a != b} == V.split_sources(before, after)


def test_growth_from_few_rows(spark, tmp_path):
    path = str(tmp_path / "kb")
    first = V.create(spark, path, chunks(spark, range(10)), "chunk_id", "document_id", rows_per_bucket=100)
    assert (first["version"], first["n_buckets"], first["rows"]) == (1, 1, 10)
    newest = V.merge(spark, path, chunks(spark, range(5, 1500)))
    assert (newest["n_buckets"], newest["rows"]) == (15, 1500)
    assert rows(V.read(spark, path)) == sorted((f"c{i}", f"d{i // 4}", "old") for i in range(1500))
    # a merge of one document rewrites one bucket, and grows by one bucket at most
    one = V.merge(spark, path, chunks(spark, [8, 9, 10, 11], "new"))
    assert len(one["rewritten"]) == 1 and one["version"] == newest["version"] + 1
    assert [r for r in rows(V.read(spark, path)) if r[2] == "new"] == [(f"c{i}", "d2", "new") for i in (10, 11, 8, 9)]
    # applied twice, the rows stay
    before = rows(V.read(spark, path))
    V.merge(spark, path, chunks(spark, [8, 9, 10, 11], "new"))
    assert rows(V.read(spark, path)) == before
    assert rows(V.read_clusters(spark, path, ["d2", "d9999"])) == [(f"c{i}", "d2", "new") for i in (10, 11, 8, 9)]
    told = V.history(spark, path).orderBy("version").collect()
    assert [r.version for r in told] == list(range(1, one["version"] + 2)) and told[-1].buckets == 15


def test_readers_keep_their_version_and_writers_collide(spark, tmp_path):
    path = str(tmp_path / "kb")
    V.create(spark, path, chunks(spark, range(50)), "chunk_id", rows_per_bucket=10)
    reader = V.read(spark, path)
    stale = V.manifest(spark, path)
    V.merge(spark, path, chunks(spark, range(20), "new"))
    assert {r[2] for r in rows(reader)} == {"old"}
    assert sum(r[2] == "new" for r in rows(V.read(spark, path))) == 20
    assert rows(V.read(spark, path, 1)) == rows(reader)
    with pytest.raises(V.VersionConflict):
        V._publish(spark, path, stale | {"version": 2})
    assert V.forget(spark, path, keep=1) >= 1
    assert sum(r[2] == "new" for r in rows(V.read(spark, path))) == 20 and len(V.versions(spark, path)) == 1


def test_a_broken_merge_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "kb")
    V.create(spark, path, chunks(spark, range(20)), "chunk_id")
    before = rows(V.read(spark, path))
    broken = chunks(spark, range(20, 30)).withColumn("content", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        V.merge(spark, path, broken)
    assert rows(V.read(spark, path)) == before and V.versions(spark, path) == [1]


def test_empty_collections_null_clusters_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "kb")
    V.create(spark, path, chunks(spark, []), "chunk_id", "document_id")
    assert V.read(spark, path).collect() == [] and V.merge(spark, path, chunks(spark, []))["version"] == 1
    V.merge(spark, path, spark.createDataFrame([("c1", None, "x"), ("c2", "d", "y")], CHUNK))
    V.merge(spark, path, spark.createDataFrame([("c2", "d", "z", 5)], CHUNK + ", score int"))
    assert sorted(map(str, V.read(spark, path).collect())) == sorted(
        ["Row(chunk_id='c1', document_id=None, content='x', score=None)", "Row(chunk_id='c2', document_id='d', content='z', score=5)"]
    )
    with pytest.raises(FileNotFoundError):
        V.read(spark, str(tmp_path / "nothing"))


def test_cache_of_overlapping_runs(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "cache_key string, model string, embedding array<float>, cached_at string"

    def entries(*given):
        return spark.createDataFrame(given, schema).withColumn("cached_at", F.col("cached_at").cast("timestamp"))

    E.store_entries(spark, path, entries(("a", "m", [1.0], "2024-01-01"), ("b", "m", [1.0], "2024-01-08"), ("b", "m", [2.0], "2024-01-09")))
    E.store_entries(spark, path, entries(("b", "m", [3.0], "2024-01-10"), ("c", "m", [3.0], "2024-01-10")))
    assert {(r.cache_key, r.embedding[0]) for r in V.read(spark, path).collect()} == {("a", 1.0), ("b", 3.0), ("c", 3.0)}
    E.compact_cache(spark, path, F.lit("2024-01-11").cast("timestamp"))
    assert {r.cache_key for r in V.read(spark, path).collect()} == {"b", "c"}
    E.compact_cache(spark, path, F.lit("2024-01-11").cast("timestamp"))  # nothing expired: nothing rewritten


def test_doubled_live_entries_do_not_double_texts(spark):
    cache = spark.createDataFrame(
        [(k, "h", [v], t) for k, v, t in (("x", 1.0, "2024-01-01"), ("x", 2.0, "2024-01-02"))], "text string, model string, embedding array<float>, at string"
    ).select(E.embedding_cache_key(F.col("text"), "h").alias("cache_key"), "model", "embedding", F.col("at").cast("timestamp").alias("cached_at"))
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    found, fresh = E.embed_documents(texts, cache, E.HashingProvider(4), model="h", now=F.lit("2024-01-03").cast("timestamp"))
    got = {r.id: r.embedding for r in found.collect()}
    assert len(got) == found.count() == 2 and got[1] == [2.0] and fresh.count() == 1
