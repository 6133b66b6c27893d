"""Queries over operations data: health, service levels, tickets, configurations, metrics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import configs as G
from opsloom.functions import services as S
from opsloom.operators import metrics as M
from opsloom.operators import operations as O
from opsloom.operators import tools as W
from opsloom.plans.catalog import query, table
from opsloom.plans.derived import derive, derived_sql
from opsloom.streaming import events as X
from opsloom.streaming.cache import cached_reads

CONFIGS = derived_sql("configs")
TICKETS = derived_sql("tickets")
SAMPLES = derived_sql("samples")
ELEMENTS = derived_sql("elements")


# --- network ----------------------------------------------------------------
def _elements(spark, sf_dir):
    """Elements with the name of their region, normalised."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = derive(spark, sf_dir, "elements").join(
        nations.select("n_nationkey", "r_name"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(F.col("r_name").alias("region"), "element_id", "status", "availability")


_ELEMENTS_SQL = (
    f"(SELECT replace(lower(r_name), ' ', '_') AS region, element_id, status, availability FROM {ELEMENTS} "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


@query(
    "network_health",
    f"""
    SELECT region, count(*) AS total_elements, round(avg(availability), 2) AS overall_availability,
           count(*) FILTER (WHERE status <> 'operational') AS degraded FROM {_ELEMENTS_SQL} GROUP BY 1
    """,
)
def network_health(spark, sf_dir):
    return O.network_health(_elements(spark, sf_dir)).drop("summary")


@query("network_degraded", f"SELECT region, element_id, status FROM {_ELEMENTS_SQL} WHERE status <> 'operational'")
def network_degraded(spark, sf_dir):
    els = _elements(spark, sf_dir).withColumn("region", S.normalize_region(F.col("region")))
    return O.degraded_elements(els)


TOPOLOGY = derived_sql("topology")


def _topology(spark, sf_dir):
    """Nodes of every region, from a table of node ranges."""
    ranges = derive(spark, sf_dir, "topology").withColumn("edge_routers", F.array(F.replace("core_router", F.lit("cr-"), F.lit("er-"))))
    return O.topology(ranges)


@query(
    "topology_expand",
    f"""
    SELECT region, 'node-' || CAST(n AS VARCHAR) AS element_id, core_router, count(user_id) AS samples, round(avg(value), 4) AS mean_value
    FROM (SELECT region, core_router, unnest(range(first, last + 1)) AS n FROM {TOPOLOGY}) t LEFT JOIN events e ON n = e.user_id % 30 GROUP BY ALL
    """,
)
def topology_expand(spark, sf_dir):
    """Measurements placed on the nodes of the configured topology; nodes without any stay."""
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("node-"), (F.col("user_id") % 30).cast("string")).alias("element_id"), "value"
    )
    per_node = ev.groupBy("element_id").agg(F.count("*").alias("samples"), F.sum("value").alias("__v"))
    out = _topology(spark, sf_dir).join(per_node, "element_id", "left")
    return out.select(
        "region", "element_id", "core_router", F.coalesce("samples", F.lit(0)).alias("samples"), F.round(F.col("__v") / F.col("samples"), 4).alias("mean_value")
    )


@query(
    "region_lookup",
    f"""
    SELECT region, error, count(*) AS requests FROM (
      SELECT region, CASE WHEN region NOT IN (SELECT region FROM {TOPOLOGY}) THEN 'Unknown region: ' || region END AS error
      FROM (SELECT replace(lower(coalesce(CASE user_id % 4 WHEN 0 THEN 'Region A' WHEN 1 THEN 'REGION_B' WHEN 2 THEN 'region z' END, 'region_a')), ' ', '_') AS region FROM events))
    GROUP BY 1, 2
    """,
)
def region_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "events").selectExpr(
        "CASE user_id % 4 WHEN 0 THEN 'Region A' WHEN 1 THEN 'REGION_B' WHEN 2 THEN 'region z' END AS region"
    )
    out = O.known_region(asked, _topology(spark, sf_dir))
    return out.groupBy("region", "error").agg(F.count("*").alias("requests"))


# --- service levels ---------------------------------------------------------
#: the moment the service levels are looked at
AS_OF = "2024-01-30 12:00:00"
_AT = f"TIMESTAMP '{AS_OF}'"
# written from the definition: gold, silver and bronze have targets, every other service the default ones;
# availability looks back 30 days, error rate one day, latency one hour, breaches 30 days
TARGETS = """
    (VALUES ('gold', 99.99::DOUBLE, 15.0::DOUBLE, 0.1::DOUBLE), ('silver', 99.95, 30.0, 1.0), ('bronze', 99.5, 50.0, 2.0))
    AS targets(tier, target_availability, target_latency, target_error_rate)
"""
TARGET_OF = """
    coalesce(target_availability, 99.95::DOUBLE) AS target_availability, coalesce(target_latency, 30.0::DOUBLE) AS target_latency,
    coalesce(target_error_rate, 1.0::DOUBLE) AS target_error_rate
"""


def _recent(days: float) -> str:
    return f"ts > {_AT} - INTERVAL {round(days * 24)} HOUR"


_COMPLIANCE_SQL = f"""
    WITH s AS (SELECT x.*, {TARGET_OF} FROM {SAMPLES} x LEFT JOIN {TARGETS} USING (tier) WHERE ts <= {_AT}),
    h AS (SELECT service_id, date_trunc('hour', ts) AS hour, avg(latency_ms) > any_value(target_latency) AS breach FROM s WHERE {_recent(30)} GROUP BY ALL),
    b AS (SELECT service_id, count(*) AS breach_count_30d, max(hour) AS last_breach FROM h WHERE breach GROUP BY ALL),
    m AS (
      SELECT region, service_id, service_name, tier, any_value(target_availability) AS target_availability,
        any_value(target_latency) AS target_latency, any_value(target_error_rate) AS target_error_rate,
        round(100.0::DOUBLE * count(*) FILTER (WHERE is_available AND {_recent(30)}) / nullif(count(*) FILTER (WHERE {_recent(30)}), 0), 3) AS current_availability,
        round(sum(latency_ms) FILTER (WHERE {_recent(1 / 24)}) / nullif(count(*) FILTER (WHERE {_recent(1 / 24)}), 0), 1) AS current_latency_ms,
        round(100.0::DOUBLE * count(*) FILTER (WHERE is_error AND {_recent(1)}) / nullif(count(*) FILTER (WHERE {_recent(1)}), 0), 2) AS current_error_rate
      FROM s GROUP BY region, service_id, service_name, tier),
    c AS (
      SELECT m.*, coalesce(breach_count_30d, 0) AS breach_count_30d, last_breach,
        coalesce(current_availability >= target_availability, true) AS availability_compliant,
        coalesce(current_latency_ms <= target_latency, true) AS latency_compliant,
        coalesce(current_error_rate <= target_error_rate, true) AS error_rate_compliant
      FROM m LEFT JOIN b USING (service_id))
    SELECT *, availability_compliant AND latency_compliant AND error_rate_compliant AS is_compliant FROM c
"""


def _compliance(spark, sf_dir):
    thresholds = O.sla_thresholds(spark)
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return O.sla_compliance(O.sla_measurements(derive(spark, sf_dir, "samples"), thresholds, at), thresholds)


@query(
    "sla_compliance",
    f"""
    SELECT region, service_id, tier, current_availability, current_latency_ms, current_error_rate, availability_compliant,
           latency_compliant, error_rate_compliant, is_compliant, breach_count_30d, last_breach FROM ({_COMPLIANCE_SQL})
    """,
)
def sla_compliance(spark, sf_dir):
    return _compliance(spark, sf_dir).select(
        "region", "service_id", "tier", "current_availability", "current_latency_ms", "current_error_rate",
        "availability_compliant", "latency_compliant", "error_rate_compliant", "is_compliant", "breach_count_30d",
        F.col("last_breach").cast("timestamp_ntz").alias("last_breach"),
    )


@query(
    "sla_status",
    f"""
    SELECT region, total_services, compliant, non_compliant, at_risk, 'Region ' || region || ': ' || compliant || '/' || total_services || ' services compliant, ' || at_risk || ' at risk' AS summary
    FROM (SELECT region, count(*) AS total_services, count(*) FILTER (WHERE is_compliant) AS compliant, count(*) FILTER (WHERE NOT is_compliant) AS non_compliant,
          count(*) FILTER (WHERE NOT is_compliant AND current_availability < target_availability + 0.1::DOUBLE) AS at_risk FROM ({_COMPLIANCE_SQL}) GROUP BY 1)
    """,
)
def sla_status(spark, sf_dir):
    return O.sla_status(_compliance(spark, sf_dir))


@query(
    "sla_at_risk",
    f"""
    SELECT region, service_id, round(a, 3) AS availability_margin, round(m, 1) AS latency_margin_ms, CASE WHEN a < 0.1::DOUBLE THEN 'high' ELSE 'medium' END AS risk_level
    FROM (SELECT region, service_id, current_availability - target_availability AS a, target_latency - current_latency_ms AS m FROM ({_COMPLIANCE_SQL}))
    WHERE a < 0.5::DOUBLE OR m < 5
    """,
)
def sla_at_risk(spark, sf_dir):
    return O.sla_at_risk(_compliance(spark, sf_dir))


_BREACHES_SQL = f"""
    SELECT region, service_id, service_name, breach_count_30d AS breach_count, last_breach, CASE WHEN is_compliant THEN 'compliant' ELSE 'breaching' END AS current_status
    FROM ({_COMPLIANCE_SQL}) WHERE breach_count_30d > 0
"""


@query("sla_breaches", _BREACHES_SQL)
def sla_breaches(spark, sf_dir):
    return O.sla_breaches(_compliance(spark, sf_dir)).withColumn("last_breach", F.col("last_breach").cast("timestamp_ntz"))


@query(
    "sla_breach_totals",
    f"SELECT region, count(*) AS services_with_breaches, CAST(sum(breach_count) AS BIGINT) AS total_breaches_30d FROM ({_BREACHES_SQL}) GROUP BY 1",
)
def sla_breach_totals(spark, sf_dir):
    return O.breach_totals(O.sla_breaches(_compliance(spark, sf_dir)))


@query(
    "sla_breach_details",
    f"""
    SELECT service_id, concat_ws('; ',
      CASE WHEN NOT availability_compliant THEN 'Availability ' || CAST(current_availability AS VARCHAR) || '% below target ' || CAST(target_availability AS VARCHAR) || '%' END,
      CASE WHEN NOT latency_compliant THEN 'Latency ' || CAST(current_latency_ms AS VARCHAR) || 'ms exceeds target ' || CAST(target_latency AS VARCHAR) || 'ms' END,
      CASE WHEN NOT error_rate_compliant THEN 'Error rate ' || CAST(current_error_rate AS VARCHAR) || '% exceeds target ' || CAST(target_error_rate AS VARCHAR) || '%' END) AS details
    FROM ({_COMPLIANCE_SQL})
    """,
)
def sla_breach_details(spark, sf_dir):
    """Breach sentences per service."""
    return _compliance(spark, sf_dir).select("service_id", F.array_join("breach_details", "; ").alias("details"))


# --- tickets ----------------------------------------------------------------
_PREFIX = "CASE category WHEN 'incident' THEN 'INC' WHEN 'change' THEN 'CHG' WHEN 'problem' THEN 'PRB' WHEN 'request' THEN 'REQ' ELSE 'TKT' END"
_CREATED_SQL = f"""
    SELECT {_PREFIX} || upper(substr(sha256('["' || CAST(request_key AS VARCHAR) || '"]'), 1, 8)) AS ticket_id, substr(title, 1, 200) AS title,
      substr(description, 1, 2000) AS description, coalesce(priority, 'medium') AS priority, 'new' AS status, category,
      CASE WHEN priority = 'critical' THEN 'noc-critical-team@{S.MAIL_DOMAIN}' WHEN category = 'change' THEN 'change-management@{S.MAIL_DOMAIN}'
           WHEN region IS NOT NULL THEN 'noc-' || region || '@{S.MAIL_DOMAIN}' ELSE 'noc-general@{S.MAIL_DOMAIN}' END AS assignee,
      region, ts AS created_at, request_key FROM {TICKETS}
"""


def _tickets(spark, sf_dir):
    requests = derive(spark, sf_dir, "tickets").withColumn(
        "affected_elements",
        F.array(
            F.concat(F.lit("node-"), (F.col("request_key") % 24 + 1).cast("string")),
            F.concat(F.lit("node-"), (F.col("request_key") % 7 + 1).cast("string")),
        ),
    )
    return O.create_tickets(requests, ["request_key"])


@query("ticket_create", f"SELECT * EXCLUDE (request_key) FROM ({_CREATED_SQL})")
def ticket_create(spark, sf_dir):
    return _tickets(spark, sf_dir).drop("affected_elements")


@query(
    "ticket_search",
    f"SELECT ticket_id, priority, assignee FROM ({_CREATED_SQL}) WHERE request_key % 24 + 1 = 5 OR request_key % 7 + 1 = 5",
)
def ticket_search(spark, sf_dir):
    found = O.search_tickets(_tickets(spark, sf_dir), status="new", element_id="node-5")
    return found.select("ticket_id", "priority", "assignee")


# --- configurations ---------------------------------------------------------
_ISSUES_SQL = f"""
    SELECT config_id, config, change_type,
      regexp_matches(c, '(?:password|secret)\\s+\\d') AND (contains(c, 'password 0') OR contains(c, 'secret 0')) AS sec1,
      contains(c, 'transport input telnet') AS sec2, len(list_distinct(regexp_extract_all(c, 'mtu\\s+(\\d+)', 1))) AS n_mtu,
      change_type = 'routing' AND NOT contains(c, 'interface loopback') AS net2,
      change_type = 'interface' AND NOT contains(c, 'service-policy') AS qos1, NOT contains(c, 'logging') AS log1,
      NOT contains(c, 'ntp server') AND NOT contains(c, 'ntp peer') AS ntp1
    FROM (SELECT *, lower(config) AS c FROM {CONFIGS})
"""
_COUNTED_SQL = f"""
    SELECT *, sec1::INT + sec2::INT + net2::INT AS e, (n_mtu > 1)::INT + qos1::INT + ntp1::INT AS w, log1::INT AS i FROM ({_ISSUES_SQL})
"""


@query(
    "config_validate",
    f"""
    SELECT config_id, e = 0 AS is_valid, NOT (sec1 OR sec2) AS policy_compliant, round_even(greatest(0, (24 - 3 * e - w) / 24.0::DOUBLE), 2) AS best_practices_score,
      e AS error_count, w AS warning_count, i AS info_count,
      concat_ws(',', CASE WHEN sec1 THEN 'SEC-001' END, CASE WHEN sec2 THEN 'SEC-002' END, CASE WHEN net2 THEN 'NET-002' END) AS errors,
      concat_ws(',', CASE WHEN n_mtu > 1 THEN 'NET-001' END, CASE WHEN qos1 THEN 'QOS-001' END, CASE WHEN ntp1 THEN 'NTP-001' END) AS warnings
    FROM ({_COUNTED_SQL})
    """,
)
def config_validate(spark, sf_dir):
    out = O.validate_configs(derive(spark, sf_dir, "configs"))

    def ids(column):
        return F.array_join(F.transform(column, lambda i: i["rule_id"]), ",").alias(column)

    return out.select(
        "config_id", "is_valid", "policy_compliant", "best_practices_score", "error_count", "warning_count", "info_count",
        ids("errors"), ids("warnings"),
    )


@query(
    "config_validate_strict",
    f"""
    SELECT config_id, e + w = 0 AS is_valid, NOT (sec1 OR sec2) AS policy_compliant, e + w AS error_count, 0 AS warning_count,
           round_even(greatest(0, (24 - 3 * e - w) / 24.0::DOUBLE), 2) AS best_practices_score FROM ({_COUNTED_SQL})
    """,
)
def config_validate_strict(spark, sf_dir):
    out = O.validate_configs(derive(spark, sf_dir, "configs"), strict=True)
    return out.select("config_id", "is_valid", "policy_compliant", "error_count", "warning_count", "best_practices_score")


@query(
    "config_rule_hits",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, '{sev}' AS severity, count(*) AS configs FROM ({_ISSUES_SQL}) WHERE {cond} HAVING count(*) > 0"
        for rule, sev, cond in [
            ("SEC-001", "error", "sec1"), ("SEC-002", "error", "sec2"), ("NET-001", "warning", "n_mtu > 1"),
            ("NET-002", "error", "net2"), ("QOS-001", "warning", "qos1"), ("LOG-001", "info", "log1"), ("NTP-001", "warning", "ntp1"),
        ]
    ),
)
def config_rule_hits(spark, sf_dir):
    """Configurations per broken rule, with the rule's row from the dimension."""
    configs = derive(spark, sf_dir, "configs").select(F.lower("config").alias("c"), "change_type")
    hits = configs.select(F.explode(G.find_issues(F.col("c"), F.col("change_type"))).alias("i"))
    counts = hits.groupBy(F.col("i.rule_id").alias("rule_id")).agg(F.count("*").alias("configs"))
    rules = F.broadcast(O.validation_rules(spark).select("rule_id", "severity"))
    return counts.join(rules, "rule_id").select("rule_id", "severity", "configs")


_PROPOSED = "replace(config, ' mtu 1500', ' mtu 9000') || chr(10) || 'ntp server 10.9.9.9' || chr(10) || '!' || chr(10)"


@query(
    "config_diff",
    f"""
    WITH pairs AS (SELECT config_id, string_split(config, chr(10)) AS cur,
                   string_split(rtrim({_PROPOSED}, chr(10)), chr(10)) AS prop FROM {CONFIGS}),
    d AS (SELECT config_id, len(list_filter(prop, lambda x: NOT list_contains(cur, x))) AS a, len(list_filter(cur, lambda x: NOT list_contains(prop, x))) AS r,
          len(list_filter(cur, lambda x: list_contains(prop, x))) AS u, array_to_string(list_filter(prop, lambda x: NOT list_contains(cur, x)), '|') AS added FROM pairs)
    SELECT config_id, a AS added_count, r AS removed_count, u AS unchanged_count, a + r AS change_count, added FROM d
    """,
    ints=("added_count", "removed_count", "unchanged_count", "change_count"),
)
def config_diff(spark, sf_dir):
    pairs = derive(spark, sf_dir, "configs").selectExpr("config_id", "config AS current_config", f"{_PROPOSED} AS proposed_config")
    out = O.diff_configs(pairs)
    return out.select(
        "config_id", "added_count", "removed_count", "unchanged_count", "change_count", F.array_join("added", "|").alias("added")
    )


# --- tools ------------------------------------------------------------------
@query(
    "tool_calls",
    f"""
    WITH req AS (SELECT event_id AS request_id, user_id, event_id % 8 AS kind, CASE WHEN user_id % 2 = 0 THEN 'region_a' ELSE 'region_b' END AS own FROM events),
    health AS (SELECT region, count(*) AS n, count(*) FILTER (WHERE status <> 'operational') AS bad FROM
      (SELECT CASE WHEN element_key % 2 = 0 THEN 'region_a' ELSE 'region_b' END AS region, status FROM {ELEMENTS}) GROUP BY 1),
    sla AS (SELECT region, count(*) AS n, count(*) FILTER (WHERE is_compliant) AS good FROM ({_COMPLIANCE_SQL}) GROUP BY 1)
    SELECT request_id, 'network_health_check' AS tool_name, 'success' AS status, CAST(n AS VARCHAR) || ' elements, ' || CAST(bad AS VARCHAR) || ' degraded' AS outcome
      FROM req JOIN health ON region = own WHERE kind = 0 AND user_id % 4 > 1
    UNION ALL SELECT request_id, 'network_health_check', 'success', CASE user_id % 4 WHEN 0 THEN 'Unknown region: nowhere' ELSE '0 elements, 0 degraded' END FROM req WHERE kind = 0 AND user_id % 4 < 2
    UNION ALL SELECT request_id, 'ticket_query', 'success', CAST((SELECT count(*) FROM orders WHERE o_orderkey % 24 + 1 = user_id % 24 + 1 OR o_orderkey % 7 + 1 = user_id % 24 + 1) AS VARCHAR) || ' tickets' FROM req WHERE kind = 1 AND user_id % 3 > 0
    UNION ALL SELECT request_id, 'ticket_query', 'success', CAST((SELECT count(*) FROM orders) AS VARCHAR) || ' tickets' FROM req WHERE kind = 1 AND user_id % 3 = 0
    UNION ALL SELECT request_id, 'sla_monitor', 'success', CAST(good AS VARCHAR) || '/' || CAST(n AS VARCHAR) FROM req JOIN sla ON region = own WHERE kind = 2
    UNION ALL SELECT request_id, 'config_diff', 'success', 'Config diff: +1 added, -0 removed' FROM req WHERE kind = 3
    UNION ALL SELECT request_id, 'capacity_planner', 'error', 'Unknown tool: capacity_planner' FROM req WHERE kind = 4
    UNION ALL SELECT request_id, 'ticket_creator', 'success', CASE user_id % 3 WHEN 0 THEN 'CHG change-management' WHEN 1 THEN 'PRB noc-critical-team' ELSE 'INC noc-' || own END FROM req WHERE kind = 5
    UNION ALL SELECT request_id, 'config_validator', 'success', CASE user_id % 3 WHEN 0 THEN 'Configuration invalid: 1 error(s), 0 warning(s)' WHEN 1 THEN 'No configuration provided'
      ELSE 'Configuration valid with 1 warning(s). Best practices score: 96%' END FROM req WHERE kind = 6
    UNION ALL SELECT request_id, NULL, 'error', 'Unknown tool: null' FROM req WHERE kind = 7
    """,
)
def tool_calls(spark, sf_dir):
    """One tool request per event through the registry: every tool, an empty region, unknown and missing tool names."""
    elements = derive(spark, sf_dir, "elements").selectExpr(
        "CASE WHEN element_key % 2 = 0 THEN 'region_a' ELSE 'region_b' END AS region", "element_id", "status", "availability"
    )
    registry = W.default_registry(elements, _tickets(spark, sf_dir), _compliance(spark, sf_dir), _topology(spark, sf_dir))
    own = "CASE WHEN user_id % 2 = 0 THEN 'Region A' ELSE 'region_b' END"
    requests = table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'network_health_check' WHEN 1 THEN 'ticket_query' WHEN 2 THEN 'sla_monitor' "
        "WHEN 3 THEN 'config_diff' WHEN 4 THEN 'capacity_planner' WHEN 5 THEN 'ticket_creator' WHEN 6 THEN 'config_validator' END AS tool_name",
        "CASE CAST(event_id % 8 AS INT) "
        f"WHEN 0 THEN map('region', CASE user_id % 4 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'Region C' ELSE {own} END) "
        "WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN map('status', 'new') ELSE map('element_id', concat('node-', user_id % 24 + 1)) END "
        f"WHEN 2 THEN map('region', {own}, 'check_type', 'status') "
        "WHEN 3 THEN map('current_config', props, 'proposed_config', concat(props, chr(10), 'new line')) "
        f"WHEN 5 THEN map('title', concat('event ', event_id), 'region', replace(lower({own}), ' ', '_'), "
        "'category', CASE user_id % 3 WHEN 0 THEN 'change' WHEN 1 THEN 'problem' ELSE 'incident' END, "
        "'priority', CASE user_id % 3 WHEN 1 THEN 'critical' ELSE 'low' END) "
        "WHEN 6 THEN map('config', CASE WHEN user_id % 3 = 1 THEN '' ELSE props END, 'strict_mode', CASE WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END) "
        "ELSE map('x', 'y') END AS params",
    )
    out = registry.execute(requests)
    data = F.from_json(
        "data", "error string, total_elements long, degraded long, count long, compliant long, total_services long, ticket_id string, assignee string"
    )
    d = F.col("d")
    outcome = F.coalesce(
        d["error"],
        F.col("error"),
        F.when(F.col("tool_name") == "network_health_check", F.format_string("%d elements, %d degraded", d["total_elements"], d["degraded"])),
        F.when(F.col("tool_name") == "ticket_query", F.format_string("%d tickets", d["count"])),
        F.when(F.col("tool_name") == "sla_monitor", F.format_string("%d/%d", d["compliant"], d["total_services"])),
        F.when(
            F.col("tool_name") == "ticket_creator",
            F.concat_ws(" ", F.substring(d["ticket_id"], 1, 3), F.substring_index(d["assignee"], "@", 1)),
        ),
        F.col("summary"),
    )
    return out.withColumn("d", data).select("request_id", "tool_name", "status", outcome.alias("outcome"))


# --- metrics ----------------------------------------------------------------
@query(
    "metric_requests",
    "SELECT '/' || event_type AS endpoint, CASE WHEN value > 100 THEN 'POST_ERROR' ELSE 'POST' END AS method, count(*) AS value FROM events GROUP BY 1, 2",
)
def metric_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        M.request_method(F.lit("POST"), F.col("value") > 100).alias("method"),
    )
    return M.counter(rows, ["endpoint", "method"])


def _histogram_sql(source: str, value: str, label: str, bounds) -> str:
    parts = [
        f"SELECT {label}, CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE {value} <= {b}) AS bucket_count, count(*) AS observations, round(sum({value}), 4) AS total FROM {source} GROUP BY 1"
        for b in bounds
    ]
    parts.append(f"SELECT {label}, NULL, count(*), count(*), round(sum({value}), 4) FROM {source} GROUP BY 1")
    return " UNION ALL ".join(parts)


_LAT = M.HISTOGRAM_BOUNDS["request_latency_seconds"]
_SECONDS = "(SELECT event_type AS endpoint, value / 10 AS seconds FROM events)"


@query("metric_latency_histogram", _histogram_sql(_SECONDS, "seconds", "endpoint", _LAT))
def metric_latency_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), (F.col("value") / 10).alias("seconds"))
    return M.histogram(rows, "seconds", _LAT, ["endpoint"]).withColumn("total", F.round("total", 4))


_DOCS_FOUND = M.HISTOGRAM_BOUNDS["rag_documents_retrieved"]


@query(
    "metric_documents_histogram",
    _histogram_sql("(SELECT 'orders' AS source, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)", "n", "source", _DOCS_FOUND).replace(
        "round(sum(n), 4)", "CAST(sum(n) AS BIGINT)"
    ),
)
def metric_documents_histogram(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return M.histogram(per.withColumn("source", F.lit("orders")), "n", _DOCS_FOUND, ["source"])


_TOOL = M.HISTOGRAM_BOUNDS["tool_latency_seconds"]


@query(
    "metric_tool_latency",
    _histogram_sql("(SELECT event_type AS tool_name, value / 50 AS s FROM events)", "s", "tool_name", _TOOL),
)
def metric_tool_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS tool_name", "value / 50 AS s")
    return M.histogram(rows, "s", _TOOL, ["tool_name"]).withColumn("total", F.round("total", 4))


_LLM = M.HISTOGRAM_BOUNDS["llm_latency_seconds"]


@query("metric_llm_latency", _histogram_sql("(SELECT 'llm' AS model, value / 20 AS s FROM events)", "s", "model", _LLM))
def metric_llm_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("'llm' AS model", "value / 20 AS s")
    return M.histogram(rows, "s", _LLM, ["model"]).withColumn("total", F.round("total", 4))


_CONFIDENCE = M.HISTOGRAM_BOUNDS["confidence_score"]


@query(
    "metric_confidence",
    _histogram_sql("(SELECT event_type AS endpoint, least(value / 128, 1) AS c FROM events)", "c", "endpoint", _CONFIDENCE),
)
def metric_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS endpoint", "least(value / 128, 1D) AS c")
    return M.histogram(rows, "c", _CONFIDENCE, ["endpoint"]).withColumn("total", F.round("total", 4))


@query(
    "metric_tool_calls",
    "SELECT event_type AS tool_name, CASE WHEN value > 100 THEN 'error' ELSE 'success' END AS status, count(*) AS value FROM events GROUP BY 1, 2",
)
def metric_tool_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS tool_name", "CASE WHEN value > 100 THEN 'error' ELSE 'success' END AS status")
    return M.counter(rows, ["tool_name", "status"])


@query(
    "metric_tokens",
    """
    SELECT 'prompt' AS type, sum(n_chars) FILTER (WHERE lang <> 'en')::BIGINT AS value FROM documents
    UNION ALL SELECT 'completion', sum(n_chars % 7) FILTER (WHERE lang = 'fr')::BIGINT FROM documents
    UNION ALL SELECT 'total', sum(n_chars) FILTER (WHERE lang = 'en')::BIGINT FROM documents
    """,
)
def metric_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "n_chars AS tokens",
        "CASE WHEN lang <> 'en' THEN n_chars END AS prompt_tokens",
        "CASE WHEN lang = 'fr' THEN n_chars % 7 END AS completion_tokens",
    )
    return M.token_counter(rows)


@query(
    "metric_active_sessions",
    "SELECT count(DISTINCT user_id) AS active_sessions FROM events WHERE ts >= TIMESTAMP '2024-01-29'",
)
def metric_active_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return M.active_sessions(rows, "user_id", F.lit("2024-01-29").cast("timestamp_ntz"))


@query("metric_knowledge_base", "SELECT count(*) AS knowledge_base_chunks FROM documents")
def metric_knowledge_base(spark, sf_dir):
    return M.knowledge_base_size(table(spark, sf_dir, "documents"))


@query("metric_grounding_failures", "SELECT count(*) FILTER (WHERE quality = 0) AS grounding_failures FROM labels")
def metric_grounding_failures(spark, sf_dir):
    return M.grounding_failures(table(spark, sf_dir, "labels").selectExpr("quality = 1 AS is_grounded"))


@query(
    "metric_quantiles",
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
)
def metric_quantiles(spark, sf_dir):
    return M.latency_quantiles(table(spark, sf_dir, "events"), "value", ["event_type"], 1_000_000)


# --- streams ----------------------------------------------------------------
def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_windows",
    f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= {_CLOSED}
    """,
)
def stream_windows(spark, sf_dir):
    """Hourly windows that the watermark has closed, written by a stream."""
    out = X.run_available(X.windowed_counts(_event_stream(spark, sf_dir), ["event_type"], value="value"), "windows")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    f"""
    WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT user_id AS session_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events
    FROM numbered GROUP BY user_id, s HAVING ended <= {_CLOSED}
    """,
)
def stream_sessions(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    out = X.run_available(X.session_activity(rows), "sessions")
    return out.select(
        "session_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events"
    )


@query("stream_dedupe", "SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Every event delivered twice, passed on once."""
    rows = _event_stream(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return X.run_available(X.first_arrivals(rows, ["event_id"]), "dedupe").select("event_id")


@query(
    "stream_histogram",
    f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, {", ".join(f"count(*) FILTER (WHERE value / 10 <= {b}) AS le_{i}" for i, b in enumerate(_LAT))}, count(*) AS observations
    FROM events GROUP BY 1 HAVING window_start + INTERVAL 1 HOUR <= {_CLOSED}
    """,
)
def stream_histogram(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).withColumn("s", F.col("value") / 10)
    out = X.run_available(X.windowed_histogram(rows, "s", _LAT), "histogram")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_cache",
    """
    WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS is_put, epoch_ms(ts) AS ms FROM events),
    p AS (SELECT user_id, event_id, ms FROM e WHERE is_put),
    r AS (SELECT e.event_id, max(p.ms) AS put_ms, max_by(p.event_id, p.ms) AS held, any_value(e.ms) AS ms
          FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.ms <= e.ms WHERE NOT e.is_put GROUP BY e.event_id)
    SELECT event_id, CASE WHEN ms - put_ms < 7200000 THEN CAST(held AS VARCHAR) END AS cached FROM r
    """,
)
def stream_cache(spark, sf_dir):
    """Purchases fill a cache per user that expires after two hours; every other event reads it."""
    rows = _event_stream(spark, sf_dir).selectExpr(
        "event_id", "user_id", "ts", "event_type = 'purchase' AS is_put", "CAST(event_id AS STRING) AS held"
    )
    return X.run_available(cached_reads(rows, "user_id", "held", "is_put", 7200, ["event_id"]), "cache", rocksdb=True)
