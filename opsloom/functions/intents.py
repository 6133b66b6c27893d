"""Intent scoring, entity extraction and tool parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opsloom.functions.text import UNICODE_NOCASE, contains_any, count_flags, flag, let

# --- fixed values -----------------------------------------------------------
#: in the order that breaks ties
INTENT_PATTERNS = {
    "diagnostic": [
        r"what is the (status|health|state) of",
        r"check (the )?(network|node|router|element)",
        r"(is|are) .* (down|degraded|operational|working)",
        r"troubleshoot",
        r"diagnose",
        r"why is .* (slow|failing|down)",
        r"current (status|metrics|performance)",
    ],
    "action": [
        r"create (a )?(ticket|incident|case)",
        r"change (the )?config",
        r"update (the )?(setting|parameter|config)",
        r"restart",
        r"reboot",
        r"apply (the )?change",
        r"schedule (a )?(maintenance|outage)",
    ],
    "escalation": [
        r"escalate",
        r"need (a )?human",
        r"speak to (an? )?(operator|engineer|person)",
        r"emergency",
        r"critical (issue|problem|outage)",
        r"urgent",
    ],
    "query": [
        r"what is",
        r"how (do|does|to|can)",
        r"explain",
        r"tell me about",
        r"describe",
        r"documentation",
        r"procedure for",
        r"best practice",
        r"policy for",
    ],
}
ENTITY_PATTERNS = {
    "region": (r"region[_\s]?([a-z]|\d+)", [1]),
    "node_id": (r"node[_\-]?(\d+)", [1]),
    "element_id": (r"(cr|er)[_\-]([a-z])[_\-](\d+)", [1, 2, 3]),
    "interface": (r"(eth|ge|xe|et)\d+(/\d+)*", [1, 2]),
    "ip_address": (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", [0]),
    "ticket_id": (r"(INC|CHG|PRB)\d+", [1]),
}
TOOLS_BY_INTENT = {
    "diagnostic": ["network_health_check", "network_config"],
    "action": ["ticket_creator", "config_validator"],
    "escalation": [],
    "query": [],
}
TOOL_REASONS = {
    "network_health_check": "Checking live network status for current metrics",
    "network_config": "Retrieving current configuration for analysis",
    "ticket_creator": "Creating incident ticket as requested",
    "config_validator": "Validating proposed configuration changes",
    "sla_monitor": "Checking SLA compliance metrics",
}
TOPIC_KEYWORDS = {
    "diagnostic": ["status", "health", "check", "performance"],
    "action": ["ticket", "change", "update", "create"],
    "escalation": ["escalate", "human", "urgent"],
    "query": ["what", "how", "explain", "documentation"],
}
KEYWORD_ENTITIES = {
    "node_id": (r"node[_\-]?\d+", 0),
    "element_id": (r"[ce]r[_\-][a-z][_\-]\d+", 0),
    "interface": (r"(eth|ge|xe)\d+", 1),
    "region": (r"region[_\s]?[a-z]", 0),
    "ip": (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0),
}
DOMAIN_TERMS = [
    "latency", "throughput", "availability", "error", "failure", "config", "configuration",
    "interface", "routing", "ospf", "bgp", "vlan", "qos", "policy", "threshold", "sla",
    "incident", "outage", "degraded", "operational", "maintenance",
]
MAX_KEYWORDS = 5
BOOST_WINDOW = 4
BOOST_STEP = 0.05
BOOST_CAP = 0.15
DEFAULT_REGION = "region_a"
DEFAULT_ELEMENT = "cr-a-01"
# --- end of fixed values ----------------------------------------------------

CATEGORIES = list(INTENT_PATTERNS)


def intent_scores(message: Column) -> Column:
    """``struct`` of one score per category; with no signal at all, ``query`` gets 0.5."""

    def matched(lowered: Column) -> Column:
        return F.struct(
            *[
                count_flags([lowered.rlike(UNICODE_NOCASE + p) for p in patterns]).alias(name)
                for name, patterns in INTENT_PATTERNS.items()
            ]
        )

    def scores(n: Column) -> Column:
        total = F.lit(0)
        for name in CATEGORIES:
            total = total + n[name]
        fields = []
        for name in CATEGORIES:
            value = F.when(n[name] > 0, F.least(F.lit(0.4) + n[name] * 0.2, F.lit(0.95))).otherwise(0.0)
            if name == "query":
                value = F.when(total == 0, 0.5).otherwise(value)
            fields.append(value.alias(name))
        return F.struct(*fields)

    return let(let(F.lower(message), matched), scores)


def best_intent(scores: Column) -> Column:
    """``struct<category, confidence>`` of the top score; earlier categories win ties."""
    top = F.greatest(*[scores[name] for name in CATEGORIES])
    category = F.lit(None).cast("string")
    for name in reversed(CATEGORIES):
        category = F.when(scores[name] == top, name).otherwise(category)
    return F.struct(category.alias("category"), top.alias("confidence"))


def topic_flags(message: Column) -> Column:
    """Per category 1 when the message mentions one of its topic words, else 0."""
    lowered = F.lower(message)
    return F.struct(*[flag(contains_any(lowered, TOPIC_KEYWORDS[c])).alias(c) for c in CATEGORIES])


def topic_boost(category: Column, recent_flags: Column) -> Column:
    """0.05 per recent message on the topic of ``category``, at most 0.15."""

    def on_topic(name: str) -> Column:
        return F.size(F.filter(recent_flags, lambda f: f[name] == 1))

    hits = F.lit(0)
    for name in CATEGORIES:
        hits = F.when(category == name, on_topic(name)).otherwise(hits)
    return F.least(hits * BOOST_STEP, F.lit(BOOST_CAP))


def requires_tools(category: Column, confidence: Column) -> Column:
    return category.isin("diagnostic", "action") & (confidence > 0.5)


def extract_entity(message: Column, kind: str) -> Column:
    """All matches of one entity kind; several groups are joined by ``-``.

    Only the captured parts are kept, as in the fixed patterns above: an
    interface keeps its prefix and last slash part, a ticket its prefix.
    """
    pattern, groups = ENTITY_PATTERNS[kind]
    # \s and \d of all scripts, ASCII letters otherwise
    found = [
        F.regexp_extract_all(message, F.lit(UNICODE_NOCASE + pattern), F.lit(g)) for g in groups
    ]
    if len(found) == 1:
        return found[0]
    return F.transform(
        F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)]),
        lambda z: F.concat_ws("-", *[z[f"g{i}"] for i in range(len(found))]),
    )


def extract_entities(message: Column) -> Column:
    """``map<kind, array<string>>``; kinds without a match are absent."""
    entries = [
        F.struct(F.lit(kind).alias("k"), extract_entity(message, kind).alias("v"))
        for kind in ENTITY_PATTERNS
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["v"]) > 0))


def search_keywords(query: Column) -> Column:
    """Distinct entities and domain terms of a query, in order of first appearance in the lists."""
    found = [
        F.regexp_extract_all(query, F.lit(UNICODE_NOCASE + pattern), F.lit(group))
        for pattern, group in KEYWORD_ENTITIES.values()
    ]
    lowered = F.lower(query)
    terms = F.filter(
        F.array(*[F.lit(t) for t in DOMAIN_TERMS]), lambda t: F.contains(lowered, t)
    )
    return F.array_distinct(F.concat(*found, terms))


def planned_tools(category: Column, available: Column) -> Column:
    """Tools suggested for the category that are also available, in suggested order."""
    suggested = F.array().cast("array<string>")
    for name, tools in TOOLS_BY_INTENT.items():
        if tools:
            suggested = F.when(category == name, F.array(*[F.lit(t) for t in tools])).otherwise(suggested)
    return F.filter(suggested, lambda t: F.array_contains(available, t))


def tool_parameters(tool: Column, message: Column, entities: Column) -> Column:
    """``map<string,string>`` of parameters for a planned tool call."""

    def first(kind: str) -> Column:
        return F.get(F.try_element_at(entities, F.lit(kind)), 0)

    inferred = F.nullif(F.regexp_extract(message, r"(?iU)region\s+([a-z])", 1), F.lit(""))
    region = F.coalesce(
        F.concat(F.lit("region_"), first("region")),
        F.concat(F.lit("region_"), F.lower(inferred)),
        F.lit(DEFAULT_REGION),
    )
    node = F.concat(F.lit("node-"), first("node_id"))
    health = _present({"region": region, "element_id": F.coalesce(node, first("element_id"))})
    config = _present(
        {
            "action": F.lit("get"),
            "element_id": F.coalesce(first("element_id"), node, F.lit(DEFAULT_ELEMENT)),
        }
    )
    urgent = F.contains(F.lower(message), F.lit("urgent"))
    ticket = _present(
        {
            "title": F.substring(message, 1, 100),
            "priority": F.when(urgent, "high").otherwise("medium"),
            "region": first("region"),
        }
    )
    validate = _present({"action": F.lit("validate")})
    return (
        F.when(tool == "network_health_check", health)
        .when(tool == "network_config", config)
        .when(tool == "ticket_creator", ticket)
        .when(tool == "config_validator", validate)
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def tool_reason(tool: Column, category: Column) -> Column:
    reason = F.concat(F.lit("Required for "), category, F.lit(" operation"))
    for name, text in TOOL_REASONS.items():
        reason = F.when(tool == name, text).otherwise(reason)
    return reason


def reasoning_text(category: Column, entities: Column, tools: Column) -> Column:
    """One-line explanation of a classification."""

    def shown(values: Column) -> Column:
        quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    pairs = F.transform(
        F.map_entries(entities), lambda e: F.concat(e["key"], F.lit(": "), shown(e["value"]))
    )
    entity_part = F.when(
        F.size(entities) > 0,
        F.concat(F.lit("Extracted entities: "), F.array_join(pairs, ", "), F.lit(".")),
    )
    tool_part = F.when(
        F.size(tools) > 0,
        F.concat(F.lit("Will call tools: "), F.array_join(tools, ", "), F.lit(".")),
    ).otherwise("No tool calls needed, using knowledge base.")
    return F.concat_ws(
        " ", F.concat(F.lit("Classified as '"), category, F.lit("' intent.")), entity_part, tool_part
    )


def _present(values: dict[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
