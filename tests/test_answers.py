import pytest
from pyspark.sql import functions as F

from opsloom.functions import prompts as P
from opsloom.operators import attribution as A


@pytest.fixture
def docs(spark):
    rows = [("r", i, f"doc{(i + 1) // 2}", 0.1 * i, "text " * 500) for i in range(1, 6)] + [("s", 1, "only", 0.5, "c")]
    return spark.createDataFrame(rows, "response_id string, rank int, source_path string, relevance double, content string")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("see [Source 3] and [1]", ["doc2", "doc1"]),
        ("[2] then [1]", ["doc1"]),
        ("[Source 99] [0]", ["doc1", "doc2"]),
        ("nothing [x]", ["doc1", "doc2"]),
        ("[99999999999999999999] [Source5]", ["doc3"]),
    ],
)
def test_attribution(spark, docs, text, expected):
    r = spark.createDataFrame([("r", text)], "response_id string, response string")
    out = A.attribute(r, docs).orderBy("position").collect()
    assert [x.document for x in out] == expected and [x.position for x in out] == list(range(1, len(out) + 1))
    if text.startswith("see"):
        assert len(out[0].excerpt) == 200 and out[0].relevance == pytest.approx(0.3)


def test_no_documents(spark, docs):
    r = spark.createDataFrame([("none", "[1]")], "response_id string, response string")
    assert A.attribute(r, docs).count() == 0


def test_context(docs):
    out = {r.response_id: r.context for r in A.response_context(docs).collect()}
    parts = out["r"].split("\n\n---\n\n")
    assert len(parts) == 5 and parts[0].startswith("[Source 1: doc1 (relevance: 0.10)]\ntext ")
    assert parts[0].endswith("...") and len(parts[0].split("\n", 1)[1]) == 1503
    assert out["s"] == "[Source 1: only (relevance: 0.50)]\nc"


def test_confidence(spark, docs):
    responses = spark.createDataFrame([("r",), ("s",), ("t",), ("none",)], "response_id string")
    tools = spark.createDataFrame([("r",), ("r",), ("r",), ("t",)], "response_id string")
    out = {r.response_id: r.confidence for r in A.confidence(responses, docs, tools).collect()}
    assert out["r"] == pytest.approx(0.5 + 0.3 + 0.3 * 0.2)
    assert out["s"] == pytest.approx(0.5 / 3 + 0.5 * 0.2)
    assert out["t"] == pytest.approx(0.15) and out["none"] == 0.3


def test_prompts(spark):
    df = spark.createDataFrame(
        [("q1", P.NO_CONTEXT, None, [], "sys"), ("q2", "ctx", [{"a": "1", "_h": "x"}, {"b": "2"}], [("user", "u"), ("assistant", "v")], "sys")],
        "query string, context string, tool_results array<map<string,string>>, history array<struct<role:string,content:string>>, system string",
    )
    out = {r.query: r.messages for r in A.build_messages(df).collect()}
    assert [m.role for m in out["q1"]] == ["system", "user"] and out["q1"][1].content == "### User Query ###\nq1"
    assert [m.role for m in out["q2"]] == ["system", "user", "assistant", "user"]
    assert out["q2"][3].content == (
        "### Retrieved Documentation ###\nctx\n\n### Live Data from Tools ###\n\nTool Result 1:\n  a: 1\n\n"
        "Tool Result 2:\n  b: 2\n\n### User Query ###\nq2"
    )


def test_texts(spark):
    df = spark.createDataFrame([(["a" * 60, "b", "c", "d"],), ([],), (None,)], "s array<string>")
    a, b, c = [r[0] for r in df.select(P.fallback_text(F.col("s"))).collect()]
    assert a.startswith("I found relevant information in: " + "a" * 50 + ", b, c. However") and b == c == P.FALLBACK_NONE
    none = F.lit(None).cast("string")
    row = df.select(P.system_context(F.lit("x"), none, "B").alias("p"), P.system_context(none, F.lit("hi"), "B").alias("q")).first()
    assert (row.p, row.q) == ("B\nFocus region: x", "B\nPriority level: hi")
    assert df.select(P.context_text(F.col("s").cast("array<string>"))).collect()[1][0] == P.NO_CONTEXT


def test_contexts_of_sorted_documents_are_collected_one_response_at_a_time(spark, docs):
    from pyspark.sql import Window

    from opsloom.session import configure

    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("response_id").orderBy("rank")))
    configure(spark)
    plan = A.response_context(ranked)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan


def test_ranked_documents_are_not_shuffled_again(spark):
    from pyspark.sql import Window

    lines = spark.range(300).selectExpr("id % 40 AS response_id", "id AS line", "'p' || id % 3 AS source_path", "0.5D AS relevance", "repeat('x', 300) AS content")
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("response_id").orderBy("line")))
    # the same number in two spellings, one document twice, a number too large for a rank
    asked = spark.range(50).selectExpr("id AS response_id", "CASE id % 3 WHEN 0 THEN '[2] [02] [99999999999999999999] [5] [1]' WHEN 1 THEN '[77]' END AS response")
    out = A.attribute(asked, ranked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan
    held = {}
    for r in ranked.orderBy("response_id", "rank").collect():
        held.setdefault(r.response_id, []).append(r.source_path)
    got = {}
    for r in out.orderBy("response_id", "position").collect():
        got.setdefault(r.response_id, []).append(r.document)
        assert r.excerpt == ("x" * 200 if r.response_id % 3 == 0 else None)
    # a response without a text cites nothing, as in the SQL
    want = {i: [names[n - 1] for n in ((2, 5, 1) if i % 3 == 0 else (1, 2, 3))] for i, names in held.items()}
    assert got == {i: list(dict.fromkeys(names)) for i, names in want.items()}
