import pytest
from pyspark.sql import functions as F

from opsloom.functions import claims as C
from opsloom.operators import grounding as G


@pytest.fixture
def check(spark):
    def run(response, context, sources=None, **options):
        df = spark.createDataFrame(
            [(response, context, sources)], "response string, context_docs array<string>, src array<string>"
        )
        return G.check_terms(df, sources="src", **options).first()

    return run


def test_grounded(check):
    r = check("The uptime of zone A is 99.95% with 5 routers.", ["Uptime of zone A is 99.95%.", "Zone A has 5 routers."])
    assert r.is_grounded and r.confidence_score > 0.5


def test_wrong_numbers_keep_term_score(check):
    r = check("The system has 100 servers", ["The system has 10 servers"])
    assert r.claims[0].confidence == pytest.approx(0.7) and r.claims[0].grounded


def test_fabricated(check):
    r = check("Zone A shows 50 flapping tunnels and 100 resets", ["Zone A is quiet."])
    assert r.ungrounded_count == 1 and not r.is_grounded
    assert r.explanation.startswith("Only 0/1 claims grounded. Ungrounded: ['Zone A shows")


@pytest.mark.parametrize("response, context", [("", ["x"]), (None, ["x"]), ("Some answer is here", []), ("Some answer", None)])
def test_empty_sides(check, response, context):
    r = check(response, context)
    assert not r.is_grounded and r.confidence_score == 0.0 and r.explanation == "Empty response or context"


def test_no_claims(check):
    r = check("What do you think? Maybe something could happen", ["x"])
    assert r.is_grounded and r.confidence_score == 1.0 and r.explanation == "No verifiable claims found"


def test_hedges_and_definitive_substrings(one):
    claims = one(C.term_claims, "I think it is so. Perhaps 12 more. Take this route today. Nothing to see. short is")
    assert claims == [["Take this route today"]]


def test_source_named_by_first_terms(check):
    r = check("Network uptime is 99 now", ["network uptime 99"], ["other.txt", "NETWORK_report.pdf"])
    assert r.claims[0].source == "NETWORK_report.pdf"


def test_trailing_dot_is_part_of_a_number(one):
    assert one(C.numbers, "5. and 5 and 7.25") == [["5.", "5", "7.25"]]


def test_key_terms_are_plain_words(one):
    (terms,) = one(C.key_terms, "the état router2 core-link has of link link a1 xy")
    assert terms == ["core", "link", "link", "link"]
    (ten,) = one(C.key_terms, " ".join(f"word{'abcdefghijkl'[i]}" for i in range(12)))
    assert len(ten) == 10


def test_ratio_is_configurable(check):
    text, context = "Alpha router is online today. Zulu gateway was replaced 9 times", ["alpha router online today"]
    assert not check(text, context).is_grounded
    assert check(text, context, min_ratio=0.5).is_grounded


def test_overlap_detector(spark):
    rows = spark.createDataFrame(
        [
            (1, "Link A is operational. Core latency is 40 ms", ["link a operational now", "core latency 40"]),
            (2, "Link Q failed at 10", ["nothing alike"]),
            (3, "Hello there", ["x"]),
            (4, "Link Q failed. Link Q failed", None),
        ],
        "id int, response string, evidence array<string>",
    )
    out = {r.id: r for r in G.check_overlap(rows).collect()}
    assert out[1].is_grounded and out[1].grounding_score == 1.0 and "Safe" in out[1].recommendation
    assert not out[2].is_grounded and "poorly" in out[2].recommendation
    assert out[3].recommendation == "No factual claims detected" and out[3].grounding_score == 1.0
    assert out[4].ungrounded_claims == ["Link Q failed"]


def test_recommendation_tiers(spark):
    rows = spark.createDataFrame([(0.95,), (0.75,), (0.5,), (0.1,)], "s double")
    texts = [r[0] for r in rows.select(C.recommendation(F.col("s"), F.lit(2), 0.7)).collect()]
    assert [t.split()[1] for t in texts] == ["well-grounded", "mostly", "partially", "poorly"]
    assert "2 claim(s)" in texts[1]


def test_overlap_rows_equal_overlap_arrays(spark):
    """The table form agrees with the array form, also when one response owns most evidence."""
    words = ["core", "link", "edge", "failed", "active", "port", "7", "limit", "ring"]
    responses = [(i, ". ".join(f"{words[i % 9]} {words[(i * k) % 9]} {words[(i + k) % 9]} {k}" for k in range(4))) for i in range(30)]
    evidence = [(0, f"{words[j % 9]} {words[(j * j) % 9]} {j % 5}") for j in range(400)]
    evidence += [(i, f"{words[j]} {words[(i + j) % 9]} {j}") for i in range(1, 25) for j in range(3)]
    r = spark.createDataFrame(responses, "response_id int, response string")
    e = spark.createDataFrame(evidence, "response_id int, evidence string")
    lists = e.groupBy("response_id").agg(F.collect_list("evidence").alias("evidence"))
    wanted = G.check_overlap(r.join(lists, "response_id", "left")).select("response_id", "claim_count", "grounding_score", "recommendation")
    got = G.check_overlap_rows(r, e).select(*wanted.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_evidence_union_drops_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (1, ""), (2, None)], "response_id int, content string")
    tools = spark.createDataFrame([(1, "{}")], "response_id int, result string")
    assert sorted(map(tuple, G.evidence_rows(docs, tools).collect())) == [(1, "a"), (1, "{}")]
