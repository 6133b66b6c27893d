import pytest
from pyspark.sql import functions as F

from opsloom.functions import intents as I
from opsloom.operators import intents as N


@pytest.fixture
def classify(spark):
    def run(text, tools=None):
        df = spark.createDataFrame([(text,)], "content string")
        return N.classify(df, available_tools=tools).first()

    return run


@pytest.mark.parametrize(
    "text, category, confidence",
    [
        ("What is the status of node-5?", "diagnostic", 0.6),
        ("create a ticket and restart it", "action", 0.8),
        ("URGENT: escalate, need a human, emergency", "escalation", 0.95),
        ("tell me about the documentation", "query", 0.8),
        ("hello there", "query", 0.5),
        ("restart and urgent", "action", 0.6),
    ],
)
def test_category(classify, text, category, confidence):
    r = classify(text)
    assert (r.category, r.confidence) == (category, pytest.approx(confidence))


def test_scores_tie_in_declared_order(one):
    (s,) = one(I.intent_scores, "what is the status of it")
    assert s.diagnostic == s.query == pytest.approx(0.6)
    assert one(lambda c: I.best_intent(I.intent_scores(c)), "what is the status of it")[0].category == "diagnostic"


def test_entities_keep_groups(one):
    text = "Region A and region_7, node-12, CR-a-01, ge0/0/1 eth3, 10.0.0.1, INC123, regional"
    (e,) = one(I.extract_entities, text)
    assert e == {
        "region": ["A", "7", "a"],
        "node_id": ["12"],
        "element_id": ["CR-a-01"],
        "interface": ["ge-/1", "eth-"],
        "ip_address": ["10.0.0.1"],
        "ticket_id": ["INC"],
    }
    assert one(I.extract_entities, "nothing") == [{}]


def test_tools_and_parameters(classify):
    r = classify("What is the status of node-5 in region b? Current status please")
    assert r.requires_tools and [c.tool_name for c in r.tool_calls] == ["network_health_check", "network_config"]
    assert r.tool_calls[0].params == {"region": "region_b", "element_id": "node-5"}
    assert r.tool_calls[1].params == {"action": "get", "element_id": "node-5"}
    assert r.reasoning == (
        "Classified as 'diagnostic' intent. Extracted entities: region: ['b'], node_id: ['5']. "
        "Will call tools: network_health_check, network_config."
    )
    r = classify("urgent: create a ticket, restart")
    assert r.tool_calls[0].params == {"title": "urgent: create a ticket, restart", "priority": "high"}
    assert [c.tool_name for c in r.tool_calls] == ["ticket_creator"]


def test_defaults_and_unavailable_tools(classify):
    r = classify("check network; diagnose", ["network_config"])
    assert [(c.tool_name, c.params) for c in r.tool_calls] == [("network_config", {"action": "get", "element_id": "cr-a-01"})]
    assert classify("check network; diagnose", []).tool_calls == []
    r = classify("explain it")
    assert not r.requires_tools and r.reasoning.endswith("No tool calls needed, using knowledge base.")


def test_search_keywords(one):
    (k,) = one(I.search_keywords, "Latency on eth0 and node_7 in Region B, configuration of ospf at 1.2.3.4")
    assert k == ["node_7", "eth", "Region B", "1.2.3.4", "latency", "config", "configuration", "ospf"]


def test_topic_boost(spark):
    msgs = [(0, "status check"), (1, "health"), (2, "performance"), (3, "check"), (4, "nothing"), (5, "what is the status of x")]
    df = spark.createDataFrame([("s", t, c) for t, c in msgs], "session_id string, ts int, content string")
    out = {r.ts: r for r in N.classify(N.with_recent_topics(df), recent="recent").collect()}
    # of the four before the last, three are on topic: 0.6 + 0.15
    assert out[5].confidence == pytest.approx(0.75)
    assert out[1].confidence == pytest.approx(0.5)
    flags = df.select(I.topic_flags(F.col("content")).alias("f")).where("f.diagnostic = 1").count()
    assert flags == 5
