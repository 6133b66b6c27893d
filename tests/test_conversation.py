import pytest
from pyspark.sql import functions as F

from opsloom.operators import conversation as V


@pytest.fixture
def messages(spark):
    rows = [("a", t, 0, "user" if t % 2 == 0 else "assistant", f"a{t}") for t in range(60)]
    rows += [("b", t, 0, "user", f"b{t}") for t in range(3)]
    df = spark.createDataFrame(rows, "session_id string, ts int, seq int, role string, content string")
    return df.withColumns({"sources": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>")})


def _texts(df, session="a"):
    return [r.content for r in df.where(F.col("session_id") == session).orderBy("ts", "seq").collect()]


def test_limits(messages):
    assert _texts(V.oldest_messages(messages)) == [f"a{t}" for t in range(50)]
    assert _texts(V.newest_messages(messages)) == [f"a{t}" for t in range(10, 60)]
    assert _texts(V.newest_messages(messages, n=10), "b") == ["b0", "b1", "b2"]
    assert [r.content for r in V.session_history(messages, "a", n=2).collect()] == ["a0", "a1"]


def test_limit_runs_before_the_shuffle(messages):
    plan = V.newest_messages(messages)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_prompt_history(messages):
    out = {r.session_id: r.history for r in V.prompt_history(messages).collect()}
    assert [m.content for m in out["a"]] == [f"a{t}" for t in range(54, 60)] and len(out["b"]) == 3
    assert out["a"][0].role == "user"


def test_save_turns_appends_and_prunes(spark, messages):
    turns = spark.createDataFrame(
        [("a", 100, "q?", "ans", ["d1"], {"k": "v"}), ("new", 5, "hi", "yo", None, None)],
        "session_id string, ts int, user_message string, reply string, sources array<string>, metadata map<string,string>",
    )
    saved = V.save_turns(messages, turns)
    assert _texts(saved) == [f"a{t}" for t in range(12, 60)] + ["q?", "ans"]
    assert _texts(saved, "new") == ["hi", "yo"]
    reply = saved.where("content = 'ans'").first()
    assert (reply.role, reply.sources, reply.metadata) == ("assistant", ["d1"], {"k": "v"})
    assert saved.where("content = 'q?'").first().sources == []


def test_sessions(spark, messages):
    known = spark.createDataFrame([("a", 5, 6)], "session_id string, created_at int, updated_at int")
    seen = messages.select("session_id", "ts")
    out = {r.session_id: (r.created_at, r.updated_at) for r in V.upsert_sessions(known, seen).collect()}
    assert out == {"a": (0, 59), "b": (0, 2)}
    assert V.session_count(messages).first()[0] == 2
    left = V.clear_sessions(messages, spark.createDataFrame([("a",), ("a",)], "session_id string"))
    assert {r.session_id for r in left.select("session_id").distinct().collect()} == {"b"}
    joined = V.with_session(messages.select("session_id", "ts"), V.upsert_sessions(known, seen))
    assert joined.count() == 63 and joined.where("session_id = 'b'").first().updated_at == 2
