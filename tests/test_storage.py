"""Collections, embedding cache and audit logs on disk."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from opsloom.operators import audit as U
from opsloom.operators import collections as L
from opsloom.operators import embedding as E
from opsloom.sources.logs import read_audit, session_audit


def _rows(df):
    return sorted((r.chunk_id, r.content) for r in df.collect())


def test_merge_of_one_document_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "col")
    first = spark.range(300).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), (F.col("id") % 60).cast("string")).alias("document_id"), F.lit("old").alias("content")
    )
    L.write_collection(first, path, "document_id", rows_per_bucket=20)
    update = spark.createDataFrame([("c5", "d5", "new"), ("x1", "d5", "new")], "chunk_id string, document_id string, content string")
    counts = L.merge_counts(update, L.read_collection(spark, path)).first()
    assert (counts.stored, counts.updated, counts.skipped) == (1, 1, 0)
    before = {f: os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("bucket_of_15_by_document_id=")}
    L.merge_into(spark, path, update)
    after = _rows(L.read_collection(spark, path))
    assert len(after) == 301 and [r for r in after if r[1] == "new"] == [("c5", "new"), ("x1", "new")]
    changed = [f for f in before if os.path.getmtime(os.path.join(path, f)) != before[f]]
    assert len(before) > 5 and len(changed) == 1
    L.merge_into(spark, path, update)
    assert _rows(L.read_collection(spark, path)) == after


def test_upsert_is_idempotent_and_split_is_complete(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "chunk_id string, content string")
    incoming = spark.createDataFrame([("b", "2"), ("c", "2")], "chunk_id string, content string")
    once = L.upsert(stored, incoming)
    assert _rows(once) == [("a", "1"), ("b", "2"), ("c", "2")] == _rows(L.upsert(once, incoming))
    new, known = L.split_new_and_known(incoming, stored)
    assert (_rows(new), _rows(known)) == ([("c", "2")], [("b", "2")])
    assert [r.chunk_id for r in L.existing_ids(stored, incoming).collect()] == ["b"]


def test_clear_collection(spark):
    spark.range(1).write.mode("overwrite").saveAsTable("kb_tmp")
    assert L.clear_collection(spark, "kb_tmp") and not L.clear_collection(spark, "kb_tmp")


# tasks cannot import a test module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    name, dimensions = "flaky", 2

    def __init__(self, failures, message):
        self.left, self.message = failures, message

    def open(self):
        pass

    def close(self):
        pass

    def embed(self, texts):
        if self.left:
            self.left -= 1
            raise RuntimeError(self.message)
        return [[1.0, 0.0] for _ in texts]


def test_retry_rules():
    waits = []
    assert E.call_with_retry(Flaky(3, "HTTP 429"), ["a"], waits.append) == [[1.0, 0.0]]
    assert waits == [1.0, 2.0, 4.0]
    with pytest.raises(E.EmbeddingError, match="Embedding failed: bad key"):
        E.call_with_retry(Flaky(1, "bad key"), ["a"], waits.append)
    waits.clear()
    with pytest.raises(E.EmbeddingError, match="after 5 attempts"):
        E.call_with_retry(Flaky(9, "quota"), ["a"], waits.append)
    # no wait after the last attempt
    assert waits == [1.0, 2.0, 4.0, 8.0]
    assert E.backoff_delay(10) == 60.0


def test_hashing_provider():
    p = E.HashingProvider(16)
    a, b, empty = p.embed(["Core link down", "core LINK down", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1.0) and empty == [0.0] * 16


def test_hashing_expression_equals_the_function(spark):
    p = E.HashingProvider(32)
    texts = ["Core link down", "", None, "a a a b", " padded  text\n", "Ärger über Öl"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.embedding for r in E.embed_column(df, "text", p).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(p.embed([t or ""])[0], abs=1e-6)


class Counting(Flaky):
    """Leaves one file for each call's texts."""

    def __init__(self, folder):
        super().__init__(0, "")
        self.folder = folder

    def embed(self, texts):
        import uuid

        for t in texts:
            open(f"{self.folder}/{t}-{uuid.uuid4().hex}", "w").close()
        return super().embed(texts)


def test_provider_is_asked_once_for_each_text(spark, tmp_path, monkeypatch):
    from opsloom.operators import skew

    texts = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i % 20}") for i in range(400)], "id int, text string")
    cache = spark.createDataFrame([], "cache_key string, model string, embedding array<float>, cached_at timestamp")
    monkeypatch.setattr(skew.lookup, "__defaults__", (0,))
    out, fresh = E.embed_documents(texts, cache, Counting(str(tmp_path)), "m")
    assert out.where("embedding IS NULL").count() == 0 and fresh.count() == 11
    assert len(os.listdir(tmp_path)) == 11


def test_cache_first_embedding(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    texts = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)] + [(99, "stale")], "id int, text string")
    cache = spark.createDataFrame([("t0", "2024-01-09"), ("stale", "2024-01-01")], "text string, day string").select(
        E.embedding_cache_key(F.col("text"), "m").alias("cache_key"),
        F.lit("m").alias("model"),
        F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")).alias("embedding"),
        F.col("day").cast("timestamp").alias("cached_at"),
    )
    out, fresh = E.embed_documents(texts, cache, Flaky(0, ""), "m", now=now)
    got = {r.id: r.embedding for r in out.collect()}
    assert len(got) == 41 and got[0] == [9.0, 9.0] and got[1] == [1.0, 0.0] and got[99] == [1.0, 0.0]
    # each distinct missing text is embedded once
    assert fresh.count() == 4 and fresh.first().model == "m"


@pytest.fixture
def entries(spark):
    base = spark.sql("SELECT 's' || id % 2 AS session_id, timestamp_ntz'2024-03-01 10:00:00.5' AS ts, 'c' || id AS correlation_id FROM range(4)")
    q = U.query_events(base.withColumn("message", F.lit("hi")))
    r = U.response_events(
        base.select("*", F.lit("x" * 3000).alias("response"), F.array(F.lit("d")).alias("sources"), F.lit(0.5).alias("confidence"), F.lit(7.0).alias("latency_ms"))
    )
    e = U.error_events(base.select("*", F.lit("boom").alias("error"), F.create_map(F.lit("error"), F.lit("no"), F.lit("a"), F.lit("b")).alias("metadata")))
    s = U.escalation_events(base.withColumn("reason", F.lit("asked")))
    t = U.tool_call_events(
        base.select(
            "*", F.lit("t").alias("tool_name"), F.create_map(F.lit("p"), F.lit("1")).alias("parameters"), F.lit("ok").alias("result_summary"),
            F.lit(3.0).alias("latency_ms"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
        )
    )
    return q.unionByName(r).unionByName(e).unionByName(s).unionByName(t)


def test_audit_round_trip(spark, entries, tmp_path):
    path = str(tmp_path / "audit")
    U.append_audit(entries.where("event_type <> 'tool_call'"), path)
    U.append_audit(entries.where("event_type = 'tool_call'"), path, max_file_bytes=1000)
    bad = tmp_path / "audit" / "day=2024-03-01" / "broken.json"
    bad.write_text('{"session_id": "s0", oops\n')
    back = read_audit(spark, path)
    assert back.count() == 20
    one = session_audit(spark, path, "s1").where("event_type = 'tool_call'").first()
    assert one.tool_calls[0].tool_name == "t" and one.tool_calls[0].parameters == {"p": "1"}
    assert one.timestamp == "2024-03-01T10:00:00.500000Z"
    files = [f for f in os.listdir(tmp_path / "audit" / "day=2024-03-01") if f.startswith("part-")]
    assert all(os.path.getsize(tmp_path / "audit" / "day=2024-03-01" / f) < 4000 for f in files) and len(files) > 2
    line = json.loads(open(tmp_path / "audit" / "day=2024-03-01" / files[0]).readline())
    assert "user_message" in line and "metadata" in line


def test_audit_events(entries):
    by_type = {r.event_type: r for r in entries.collect()}
    assert len(by_type["response"].assistant_response) == 1000 and by_type["response"].confidence_score == 0.5
    assert by_type["error"].metadata == {"a": "b", "error": "boom", "error_type": "processing_error"}
    assert by_type["escalation"].metadata == {"escalation_reason": "asked", "escalation_type": "human_handoff"}
    assert by_type["query"].tool_calls == [] and by_type["query"].user_message == "hi"
    assert {r.event_type: r.entries for r in U.event_counts(entries).collect()} == dict.fromkeys(U.EVENT_TYPES, 4)


def test_iso_time_without_fraction(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-01 10:00:00' AS ts")
    assert df.select(U.iso_time(F.col("ts"))).first()[0] == "2024-03-01T10:00:00Z"
