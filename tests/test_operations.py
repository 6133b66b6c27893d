import json

import pytest
from pyspark.sql import functions as F

from opsloom.functions import services as S
from opsloom.operators import operations as O
from opsloom.operators.tools import Tool, ToolRegistry, default_registry

GOOD = "interface ge0/1\n ip address 10.0.0.1 255.255.255.0\n!\nntp server 10.0.0.9\nlogging host 10.0.0.8\n"


@pytest.fixture
def validate(spark):
    def run(config, change=None, strict=False):
        df = spark.createDataFrame([(config, change)], "config string, change_type string")
        return O.validate_configs(df, strict=strict).first()

    return run


def _ids(issues):
    return [i.rule_id for i in issues]


def test_valid_config(validate):
    r = validate(GOOD)
    assert r.is_valid and r.policy_compliant and r.best_practices_score == 1.0
    assert r.summary == "Configuration valid. Best practices score: 100%"


@pytest.mark.parametrize(
    "config, change, errors, warnings, info",
    [
        ("username x password 0 abc", "security", ["SEC-001"], ["NTP-001"], ["LOG-001"]),
        ("username x password 7 abc", None, [], ["NTP-001"], ["LOG-001"]),
        ("enable secret 0 abc", None, ["SEC-001"], ["NTP-001"], ["LOG-001"]),
        ("line vty 0 4\n TRANSPORT input telnet", None, ["SEC-002"], ["NTP-001"], ["LOG-001"]),
        (GOOD + "mtu 1500\nMTU 9000", None, [], ["NET-001"], []),
        (GOOD + "mtu 1500\nmtu 1500", None, [], [], []),
        (GOOD, "routing", ["NET-002"], [], []),
        (GOOD + "interface Loopback0", "routing", [], [], []),
        (GOOD, "interface", [], ["QOS-001"], []),
        (GOOD + "service-policy x", "interface", [], [], []),
    ],
)
def test_rules(validate, config, change, errors, warnings, info):
    r = validate(config, change)
    assert (_ids(r.errors), _ids(r.warnings), _ids(r.info)) == (errors, warnings, info)
    assert r.is_valid == (not errors)


def test_score_is_fixed_before_strict_mode(validate):
    loose, strict = validate("mtu 1\nmtu 2", "interface"), validate("mtu 1\nmtu 2", "interface", strict=True)
    assert loose.is_valid and loose.warning_count == 3 and loose.best_practices_score == 0.88
    assert loose.summary == "Configuration valid with 3 warning(s). Best practices score: 88%"
    assert not strict.is_valid and strict.error_count == 3 and strict.warning_count == 0
    assert strict.best_practices_score == loose.best_practices_score and strict.policy_compliant
    assert strict.summary == "Configuration invalid: 3 error(s), 0 warning(s)"
    assert loose.warnings[0].message == "Inconsistent MTU values: 1, 2"


def test_empty_config(validate):
    for config in ("", None):
        r = validate(config)
        assert r.error == "No configuration provided" and r.is_valid is None


@pytest.mark.parametrize(
    "current, proposed, added, removed, unchanged",
    [
        ("l1\nl2", "l1\nl2\nl3", ["l3"], [], 2),
        ("l1\nl2\nl3", "l1\nl2", [], ["l3"], 2),
        ("same\n", "same", [], [], 1),
        ("a\na\nb", "b\nc\nc", ["c", "c"], ["a", "a"], 1),
        ("", "x\r\ny", ["x", "y"], [], 0),
        (None, "", [], [], 0),
        ("p\x0bq", "p", [], ["q"], 1),
    ],
)
def test_diff(spark, current, proposed, added, removed, unchanged):
    df = spark.createDataFrame([(current, proposed)], "current_config string, proposed_config string")
    r = O.diff_configs(df).first()
    assert (r.added, r.removed, r.unchanged_count, r.change_count) == (added, removed, unchanged, len(added) + len(removed))


def test_tickets(spark):
    rows = [
        (1, "t" * 300, "d" * 3000, "critical", "incident", None, ["n1"]),
        (2, "x", None, "high", "change", "region_a", None),
        (3, None, "y", None, "problem", "region_b", ["n2", "n1"]),
        (4, "z", "y", "low", "request", None, None),
        (5, "z", "y", "low", "odd", "", None),
    ]
    df = spark.createDataFrame(
        rows, "k int, title string, description string, priority string, category string, region string, affected_elements array<string>"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    made = O.create_tickets(df, ["k"], keep=("k",))
    out = {r.k: r for r in made.collect()}
    assert [out[k].ticket_id[:3] for k in range(1, 6)] == ["INC", "CHG", "PRB", "REQ", "TKT"]
    assert len(out[1].title) == 200 and len(out[1].description) == 2000 and out[3].title == "Untitled Ticket"
    assert [out[k].assignee.split("@")[0] for k in range(1, 6)] == [
        "noc-critical-team", "change-management", "noc-region_b", "noc-general", "noc-general",
    ]
    assert out[3].priority == "medium" and {r.status for r in out.values()} == {"new"}
    assert {r.k: r.ticket_id for r in made.collect()} == {k: r.ticket_id for k, r in out.items()}
    assert O.search_tickets(made, ticket_id=out[2].ticket_id, status="closed").count() == 1
    assert {r.k for r in O.search_tickets(made, status="new", element_id="n1").collect()} == {1, 3}
    assert O.search_tickets(made, status="closed").count() == 0 and O.search_tickets(made).count() == 5


@pytest.fixture
def compliance(spark):
    rows = [
        ("region_a", "s1", "One", "gold", 99.995, 10.0, 0.05, 0),
        ("region_a", "s2", "Two", "silver", 99.9, 45.5, 0.5, 2),
        ("region_b", "s3", "Three", "bronze", 100.0, 10.0, 0.1, 0),
    ]
    measured = spark.createDataFrame(
        rows,
        "region string, service_id string, service_name string, tier string, current_availability double, "
        "current_latency_ms double, current_error_rate double, breach_count_30d long",
    ).withColumn("last_breach", F.lit("2024-01-01").cast("timestamp_ntz"))
    return O.sla_compliance(measured, O.sla_thresholds(spark))


def test_sla(compliance):
    c = {r.service_id: r for r in compliance.collect()}
    assert c["s1"].is_compliant and not c["s2"].is_compliant and c["s3"].is_compliant
    assert c["s2"].breach_details == ["Availability 99.9% below target 99.95%", "Latency 45.5ms exceeds target 30.0ms"]
    status = {r.region: r for r in O.sla_status(compliance).collect()}
    assert status["region_a"].summary == "Region region_a: 1/2 services compliant, 1 at risk"
    risk = {r.service_id: r for r in O.sla_at_risk(compliance).collect()}
    assert set(risk) == {"s1", "s2"} and risk["s1"].risk_level == "high" and risk["s1"].availability_margin == 0.005
    breaches = O.sla_breaches(compliance)
    assert [(r.service_id, r.breach_count, r.current_status) for r in breaches.collect()] == [("s2", 2, "breaching")]
    assert O.breach_totals(breaches).first().total_breaches_30d == 2


def test_dimensions(spark):
    t = O.topology(ranges(spark))
    assert t.groupBy("region").count().where("count = 12").count() == 3
    assert O.validation_rules(spark).count() == 8
    found = {r.tier: (r.target_availability, r.target_latency_ms, r.target_error_rate) for r in O.sla_thresholds(spark).collect()}
    assert found == {"gold": (99.99, 15.0, 0.1), "silver": (99.95, 30.0, 1.0), "bronze": (99.5, 50.0, 2.0), None: (99.95, 30.0, 1.0)}
    windows = O.sla_thresholds(spark).select("window_availability", "window_latency", "window_error_rate").distinct().collect()
    assert [tuple(w) for w in windows] == [("monthly", "hourly", "daily")]
    assert S.WINDOW_SECONDS == {"hourly": 3600, "daily": 86400, "monthly": 2592000}


def ranges(spark):
    rows = [(f"region_{c}", 12 * i + 1, 12 * i + 12, f"cr-{c}-01", []) for i, c in enumerate("abc")]
    return spark.createDataFrame(rows, "region string, first int, last int, core_router string, edge_routers array<string>")


def test_services_of_any_tier_are_measured_in_their_windows(spark):
    at, day = 1_700_000_000, 86_400
    rows = []
    for service, tier in (("s1", "gold"), ("s2", "platinum"), ("s3", None)):
        rows += [
            (service, tier, at - 10, 40.0, False, True),  # this hour
            (service, tier, at - 2 * 3600, 10.0, True, True),  # this day
            (service, tier, at - 5 * day, 100.0, True, False),  # this month
            (service, tier, at - 40 * day, 900.0, True, False),  # too old for anything
            (service, tier, at + 60, 900.0, True, False),  # still to come
        ]
    rows.append(("old", "gold", at - 90 * day, 900.0, True, False))
    df = spark.createDataFrame(rows, "service_id string, tier string, at long, latency_ms double, is_error boolean, is_available boolean")
    df = df.select(F.lit("r").alias("region"), F.col("service_id").alias("service_name"), "*", F.timestamp_seconds("at").alias("ts")).drop("at")
    thresholds = O.sla_thresholds(spark)
    measured = O.sla_measurements(df, thresholds, F.timestamp_seconds(F.lit(at)))
    out = {r.service_id: r for r in O.sla_compliance(measured, thresholds).collect()}
    assert set(out) == {"s1", "s2", "s3", "old"}
    for s in ("s1", "s2", "s3"):
        assert (out[s].current_availability, out[s].current_latency_ms, out[s].current_error_rate) == (66.667, 40.0, 50.0)
        assert out[s].breach_count_30d == 2
    assert out["s1"].target_latency_ms == 15.0 and out["s2"].target_latency_ms == out["s3"].target_latency_ms == 30.0
    old = out["old"]
    assert (old.current_availability, old.current_latency_ms, old.breach_count_30d, old.last_breach, old.is_compliant) == (None, None, 0, None, True)


def test_network_health(spark):
    els = spark.createDataFrame(
        [("Region A", "n1", "operational", 99.5), ("region_a", "n2", "down", 10.25), ("region_b", "n3", "degraded", 97.0)],
        "region string, element_id string, status string, availability double",
    )
    out = {r.region: r for r in O.network_health(els).collect()}
    assert out["region_a"].summary == "Region region_a: 2 elements, availability: 54.88%, degraded: 1"
    assert {r.element_id for r in O.degraded_elements(els).collect()} == {"n2", "n3"}


@pytest.fixture
def registry(spark, compliance):
    els = spark.createDataFrame(
        [("region_a", "node-1", "operational", 99.5), ("region_a", "node-2", "down", 0.0), ("region_b", "node-13", "degraded", 97.0)],
        "region string, element_id string, status string, availability double",
    )
    reqs = spark.createDataFrame(
        [(1, "Down", "x", "high", "incident", "region_a", ["node-2"])],
        "k int, title string, description string, priority string, category string, region string, affected_elements array<string>",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    return default_registry(els, O.create_tickets(reqs, ["k"]), compliance, O.topology(ranges(spark)))


def test_registry(spark, registry):
    calls = [
        ("h1", "network_health_check", {"region": "Region A"}),
        ("h2", "network_health_check", {"region": "region_a", "element_id": "node-2"}),
        ("h3", "network_health_check", {"region": "mars"}),
        ("h4", "network_health_check", {}),
        ("h5", "network_health_check", {"region": "region c"}),
        ("n1", None, {}),
        ("s5", "sla_monitor", {"region": "region_c"}),
        ("q5", "ticket_query", {"status": "odd"}),
        ("t1", "ticket_creator", {"title": "Broken", "category": "change"}),
        ("q1", "ticket_query", {"status": "new", "element_id": "node-2"}),
        ("q2", "ticket_query", {"ticket_id": "INC404"}),
        ("q3", "ticket_query", {}),
        ("q4", "ticket_query", {"status": "closed"}),
        ("s1", "sla_monitor", {"region": "region_a"}),
        ("s2", "sla_monitor", {"region": "region_a", "service_id": "s2", "check_type": "breaches"}),
        ("s3", "sla_monitor", {"region": "region_a", "service_id": "nope"}),
        ("s4", "sla_monitor", {"region": "region_b", "check_type": "at_risk"}),
        ("v1", "config_validator", {"config": GOOD, "strict_mode": "true"}),
        ("v2", "config_validator", {}),
        ("d1", "config_diff", {"current_config": "a", "proposed_config": "a\nb"}),
        ("u1", "teleport", {}),
    ]
    df = spark.createDataFrame(calls, "request_id string, tool_name string, params map<string,string>")
    out = {r.request_id: r for r in registry.execute(df).collect()}
    assert set(out) == {c[0] for c in calls}
    data = {k: json.loads(r.data) for k, r in out.items()}
    assert data["h1"]["total_elements"] == 2 and data["h4"]["total_elements"] == 2
    assert out["h2"].summary == "node-2: down, availability: 0.0%"
    assert data["h3"]["error"] == "Unknown region: mars" and out["h3"].status == "success"
    assert data["h5"]["total_elements"] == 0 and out["h5"].summary == "Region region_c: 0 elements, availability: n/a, degraded: 0"
    assert (out["n1"].tool_name, out["n1"].status, out["n1"].error) == (None, "error", "Unknown tool: null")
    assert data["s5"]["total_services"] == 0 and data["q5"]["count"] == 0
    assert data["t1"]["ticket_id"].startswith("CHG") and data["t1"]["assignee"].startswith("change-management")
    assert (data["q1"]["count"], data["q3"]["count"], data["q4"]["count"]) == (1, 1, 0)
    assert data["q2"]["error"] == "Ticket INC404 not found"
    assert data["s1"]["compliant"] == 1 and data["s2"]["total_breaches_30d"] == 2
    assert data["s3"]["error"] == "Service nope not found in region_a" and data["s4"]["count"] == 0
    assert data["v1"]["is_valid"] and data["v2"]["error"] == "No configuration provided"
    assert data["d1"]["added"] == ["b"]
    assert (out["u1"].status, out["u1"].error, out["u1"].summary) == ("error", "Unknown tool: teleport", "Tool 'teleport' not found")


def test_registry_contract(spark):
    registry = ToolRegistry()
    registry.register(Tool("t", "first", lambda df: df))
    registry.register(Tool("t", "second", lambda df: df.select("missing")))
    assert [t["function"]["description"] for t in registry.list_tools()] == ["second"] and registry.get("x") is None
    df = spark.createDataFrame([("1", "t", {})], "request_id string, tool_name string, params map<string,string>")
    r = registry.execute(df).first()
    assert r.status == "error" and r.summary.startswith("Tool 't' failed: ")
