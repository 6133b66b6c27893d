"""Queries over conversations and audit events."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import intents as I
from opsloom.operators import audit as U
from opsloom.operators import conversation as V
from opsloom.operators import intents as N
from opsloom.plans.catalog import query, table, texts
from opsloom.plans.derived import derive, derived_sql
from opsloom.plans.sqltext import lit
from opsloom.session import scratch_dir
from opsloom.sources.logs import read_audit

CHAT = derived_sql("chat")


# --- intents ----------------------------------------------------------------
def _scores_sql(source: str, key: str, t: str, keep: str = "") -> str:
    def n(name: str) -> str:
        return " + ".join(f"CAST(regexp_matches(lower({t}), {lit('(?i)' + p)}) AS INTEGER)" for p in I.INTENT_PATTERNS[name])

    counts = ", ".join(f"{n(c)} AS n_{c}" for c in I.CATEGORIES)
    none = " AND ".join(f"n_{c} = 0" for c in I.CATEGORIES)

    def score(c: str) -> str:
        base = f"CASE WHEN n_{c} > 0 THEN least(0.4::DOUBLE + n_{c} * 0.2::DOUBLE, 0.95::DOUBLE) ELSE 0::DOUBLE END"
        return f"CASE WHEN {none} THEN 0.5::DOUBLE ELSE {base} END" if c == "query" else base

    scores = ", ".join(f"{score(c)} AS {c}" for c in I.CATEGORIES)
    return f"SELECT {key}{keep}, {scores} FROM (SELECT {key}{keep}, {counts} FROM {source})"


_TOP = "greatest(" + ", ".join(I.CATEGORIES) + ")"
_BEST = "CASE " + " ".join(f"WHEN {c} = {_TOP} THEN '{c}'" for c in I.CATEGORIES) + " END"


@query("intent_scores_conversations", _scores_sql("conversations", "conv_id, turn", "text"))
def intent_scores_conversations(spark, sf_dir):
    rows = texts(spark, sf_dir, "conversations").select("conv_id", "turn", I.intent_scores(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", "s.*")


@query("intent_scores", _scores_sql(CHAT, "message_id", "content"))
def intent_scores(spark, sf_dir):
    return derive(spark, sf_dir, "chat").select("message_id", I.intent_scores(F.col("content")).alias("s")).select("message_id", "s.*")


def _entity_sql(kind: str) -> str:
    pattern, groups = I.ENTITY_PATTERNS[kind]
    found = [f"regexp_extract_all(content, {lit('(?i)' + pattern)}, {g})" for g in groups]
    if len(found) == 1:
        return f"array_to_string({found[0]}, '|')"
    parts = " || '-' || ".join(f"coalesce(z[{i + 1}], '')" for i in range(len(found)))
    return f"array_to_string(list_transform(list_zip({', '.join(found)}), lambda z: {parts}), '|')"


@query(
    "entity_extract",
    "SELECT message_id, " + ", ".join(f"{_entity_sql(k)} AS {k}" for k in I.ENTITY_PATTERNS) + f" FROM {CHAT}",
)
def entity_extract(spark, sf_dir):
    chat = derive(spark, sf_dir, "chat")
    return chat.select(
        "message_id",
        *[F.array_join(I.extract_entity(F.col("content"), k), "|").alias(k) for k in I.ENTITY_PATTERNS],
    )


@query(
    "intent_classify",
    f"""
    SELECT message_id, category, confidence, tool AS planned_tools,
           category IN ('diagnostic', 'action') AND confidence > 0.5 AS requires_tools
    FROM (SELECT *, CASE WHEN category IN ('diagnostic', 'action') AND confidence > 0.5 THEN
            CASE category WHEN 'diagnostic' THEN 'network_health_check,network_config' ELSE 'ticket_creator' END ELSE '' END AS tool
          FROM (SELECT message_id, {_BEST} AS category, {_TOP} AS confidence FROM ({_scores_sql(CHAT, "message_id", "content")})))
    """,
)
def intent_classify(spark, sf_dir):
    out = N.classify(derive(spark, sf_dir, "chat"))
    names = F.array_join(F.transform("tool_calls", lambda c: c["tool_name"]), ",")
    return out.select("message_id", "category", "confidence", names.alias("planned_tools"), "requires_tools")


def _topic_sql(category: str) -> str:
    words = " OR ".join(f"contains(lower(content), '{w}')" for w in I.TOPIC_KEYWORDS[category])
    return f"sum(CASE WHEN {words} THEN 1 ELSE 0 END) OVER w"


@query(
    "intent_with_context",
    f"""
    WITH boosted AS (SELECT message_id, {", ".join(f"coalesce({_topic_sql(c)}, 0) AS t_{c}" for c in I.CATEGORIES)}
                     FROM {CHAT} WINDOW w AS (PARTITION BY session_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
    best AS (SELECT message_id, {_BEST} AS category, {_TOP} AS confidence FROM ({_scores_sql(CHAT, "message_id", "content")}))
    SELECT message_id, category, round(least(confidence + least(0.05::DOUBLE * CASE category {" ".join(f"WHEN '{c}' THEN t_{c}" for c in I.CATEGORIES)} END, 0.15::DOUBLE), 1), 6) AS confidence
    FROM best JOIN boosted USING (message_id)
    """,
)
def intent_with_context(spark, sf_dir):
    """Confidence raised by the four messages before each one in its session."""
    out = N.category_in_context(derive(spark, sf_dir, "chat"), "message_id")
    return out.withColumn("confidence", F.round("confidence", 6))


_ELEMENT = " || '-' || ".join(f"regexp_extract(content, {lit('(?i)' + I.ENTITY_PATTERNS['element_id'][0])}, {g})" for g in (1, 2, 3))


@query(
    "planned_tool_calls",
    f"""
    WITH best AS (SELECT message_id, content, {_BEST} AS category, {_TOP} AS confidence FROM ({_scores_sql(CHAT, "message_id", "content", ", content")})),
    needed AS (SELECT *, regexp_extract(content, '(?i)region[_\\s]?([a-z]|\\d+)', 1) AS reg, regexp_extract(content, '(?i)node[_\\-]?(\\d+)', 1) AS node,
               {_ELEMENT} AS el0
               FROM best WHERE category IN ('diagnostic', 'action') AND confidence > 0.5),
    parts AS (SELECT *, CASE WHEN el0 = '--' THEN '' ELSE el0 END AS el FROM needed)
    SELECT message_id, 'network_health_check' AS tool_name, CASE WHEN reg = '' THEN 'region_a' ELSE 'region_' || reg END AS region,
           coalesce('node-' || nullif(node, ''), nullif(el, '')) AS element_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS priority FROM parts WHERE category = 'diagnostic'
    UNION ALL SELECT message_id, 'network_config', NULL, coalesce(nullif(el, ''), 'node-' || nullif(node, ''), 'cr-a-01'), NULL, NULL FROM parts WHERE category = 'diagnostic'
    UNION ALL SELECT message_id, 'ticket_creator', nullif(reg, ''), NULL, substr(content, 1, 100), CASE WHEN contains(lower(content), 'urgent') THEN 'high' ELSE 'medium' END FROM parts WHERE category = 'action'
    """,
)
def planned_tool_calls(spark, sf_dir):
    calls = N.planned_calls(N.classify(derive(spark, sf_dir, "chat")), "message_id")
    return calls.select(
        "message_id",
        "tool_name",
        *[F.try_element_at("params", F.lit(p)).alias(p) for p in ("region", "element_id", "title", "priority")],
    )


_OPEN, _BETWEEN, _CLOSE = "['", "', '", "']"
_ENTITY_LIST = ", ".join(
    f"CASE WHEN {k} <> '' THEN {lit(k + ': ' + _OPEN)} || replace({k}, '|', {lit(_BETWEEN)}) || {lit(_CLOSE)} END"
    for k in I.ENTITY_PATTERNS
)


@query(
    "intent_reasoning",
    f"""
    WITH found AS (SELECT message_id, {", ".join(f"{_entity_sql(k)} AS {k}" for k in I.ENTITY_PATTERNS)} FROM {CHAT}),
    shown AS (SELECT message_id, concat_ws(', ', {_ENTITY_LIST}) AS ents FROM found),
    best AS (SELECT message_id, {_BEST} AS category, {_TOP} AS confidence FROM ({_scores_sql(CHAT, "message_id", "content")}))
    SELECT message_id, 'Classified as ''' || category || ''' intent.' || CASE WHEN ents <> '' THEN ' Extracted entities: ' || ents || '.' ELSE '' END
      || CASE WHEN category = 'diagnostic' AND confidence > 0.5 THEN ' Will call tools: network_health_check, network_config.'
              WHEN category = 'action' AND confidence > 0.5 THEN ' Will call tools: ticket_creator.' ELSE ' No tool calls needed, using knowledge base.' END AS reasoning
    FROM best JOIN shown USING (message_id)
    """,
)
def intent_reasoning(spark, sf_dir):
    """Explanation text per message."""
    return N.classify(derive(spark, sf_dir, "chat")).select("message_id", "reasoning")


# --- conversation history ---------------------------------------------------
@query("history_oldest", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5")
def history_oldest(spark, sf_dir):
    return V.oldest_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 5)


@query(
    "history_prune",
    f"SELECT message_id, session_id FROM {CHAT} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) <= 50",
)
def history_prune(spark, sf_dir):
    chat = derive(spark, sf_dir, "chat")
    return V.newest_messages(chat, n=50, tie="message_id").select("message_id", "session_id")


@query("context_window", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def context_window(spark, sf_dir):
    return V.newest_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", V.CONTEXT_WINDOW).select("conv_id", "turn", "role")


@query(
    "prompt_history",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id",
)
def prompt_history(spark, sf_dir):
    out = V.prompt_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", content="text")
    texts = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.select("conv_id", F.array_join(texts, "\n").alias("history"))


@query("session_history", f"SELECT message_id, ts, role, content FROM {CHAT} WHERE session_id = 7 ORDER BY ts LIMIT 50")
def session_history(spark, sf_dir):
    return V.session_history(derive(spark, sf_dir, "chat"), 7).select("message_id", "ts", "role", "content")


@query(
    "save_turns",
    f"""
    WITH turns AS (SELECT user_id AS session_id, ts, props AS q, event_type AS a FROM events),
    merged AS (SELECT session_id, ts, 0 AS seq, role, content FROM {CHAT}
      UNION ALL SELECT session_id, ts + INTERVAL 40 DAY, 0, 'user', q FROM turns
      UNION ALL SELECT session_id, ts + INTERVAL 40 DAY, 1, 'assistant', a FROM turns)
    SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) <= 50
    """,
)
def save_turns(spark, sf_dir):
    """Append one finished turn for every event, then prune."""
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    stored = derive(spark, sf_dir, "chat").select(
        "session_id", "ts", F.lit(0).alias("seq"), "role", "content", none.alias("sources"), empty.alias("metadata")
    )
    turns = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.expr("ts + INTERVAL 40 DAY").alias("ts"),
        F.col("props").alias("user_message"),
        F.col("event_type").alias("reply"),
        F.lit(None).cast("array<string>").alias("sources"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    return V.save_turns(stored, turns).select("session_id", "ts", "seq", "role", "content")


@query(
    "session_upsert",
    f"""
    WITH seen AS (SELECT user_id AS session_id, ts FROM events),
    stored AS (SELECT session_id + 10 AS session_id, min(ts) - INTERVAL 1 DAY AS created_at, max(ts) + INTERVAL 1 HOUR AS updated_at FROM seen GROUP BY 1)
    SELECT coalesce(s.session_id, n.session_id) AS session_id, coalesce(least(s.created_at, n.first_ts), s.created_at, n.first_ts) AS created_at,
      coalesce(greatest(s.updated_at, n.last_ts), s.updated_at, n.last_ts) AS updated_at
    FROM stored s FULL JOIN (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts FROM seen GROUP BY 1) n ON s.session_id = n.session_id
    """,
)
def session_upsert(spark, sf_dir):
    """Stored sessions that begin earlier, end later, or were not seen again, and sessions not stored yet."""
    seen = derive(spark, sf_dir, "chat")
    stored = seen.groupBy((F.col("session_id") + 10).alias("session_id")).agg(
        F.expr("min(ts) - INTERVAL 1 DAY").alias("created_at"), F.expr("max(ts) + INTERVAL 1 HOUR").alias("updated_at")
    )
    return V.upsert_sessions(stored, seen)


@query("session_count", "SELECT count(DISTINCT user_id) AS session_count FROM events")
def session_count(spark, sf_dir):
    return V.session_count(derive(spark, sf_dir, "chat"))


@query(
    "session_clear",
    "SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id NOT IN "
    "(SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1",
)
def session_clear(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    left = V.clear_sessions(rows, rows.where("role = 'system'"), "conv_id")
    return left.groupBy("conv_id").agg(F.count("*").alias("messages"))


@query(
    "messages_with_session",
    f"SELECT message_id, session_id, created_at, updated_at FROM {CHAT} JOIN "
    "(SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1) USING (session_id)",
)
def messages_with_session(spark, sf_dir):
    chat = derive(spark, sf_dir, "chat")
    sessions = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("session_id"))
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    )
    return V.with_session(chat.select("message_id", "session_id"), sessions)


# --- audit ------------------------------------------------------------------
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || 'Z'"


def _entries(spark, sf_dir):
    """Audit entries of all five kinds from the events."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "ts",
        "event_type",
        "value",
        F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("correlation_id"),
        F.col("props"),
    )
    kinds = {"view": "query", "click": "response", "purchase": "tool_call", "error": "error", "signup": "escalation"}
    kind = F.lit("escalation")
    for name, value in kinds.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    props, value = F.col("props"), F.col("value")
    rows = ev.select(
        "session_id", "ts", "correlation_id", kind.alias("kind"), props.alias("message"), F.expr("repeat(props, 200)").alias("response"),
        F.array(F.lit("kb/a"), F.lit("kb/b")).alias("sources"), (value / 1000).alias("confidence"), value.alias("latency_ms"),
        F.lit("ticket_creator").alias("tool_name"), F.create_map(F.lit("props"), props).alias("parameters"),
        F.lit("done").alias("result_summary"), (value < 100).alias("success"), props.alias("reason"),
        F.when(F.col("event_type") == "error", props).alias("error"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("error"), F.lit("overwritten"), F.lit("kept"), F.lit("yes"))).alias("metadata"),
    )
    return U.events_of_all_kinds(rows, F.col("kind"))


_AUDIT_SQL = (
    f"""
    SELECT CAST(user_id AS VARCHAR) AS session_id, {_ISO} AS timestamp, 'c-' || CAST(event_id AS VARCHAR) AS correlation_id,
      CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'error' ELSE 'escalation' END AS event_type,
      CASE WHEN event_type = 'view' THEN props END AS user_message,
      CASE WHEN event_type = 'click' THEN substr(repeat(props, 200), 1, 1000) END AS assistant_response,
      CASE WHEN event_type = 'click' THEN 'kb/a,kb/b' ELSE '' END AS sources_used,
      CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE 0 END AS latency_ms,
      CASE event_type WHEN 'error' THEN props WHEN 'signup' THEN props END AS detail,
      CASE event_type WHEN 'error' THEN 'processing_error' WHEN 'signup' THEN 'human_handoff' END AS kind,
      CASE WHEN event_type = 'error' THEN 'yes' END AS kept,
      CASE WHEN event_type = 'purchase' THEN value < 100 END AS success
    FROM events
    """
)


def _flat_entries(e):
    def meta(*names):
        return F.coalesce(*[F.try_element_at("metadata", F.lit(n)) for n in names])

    return e.select(
        "session_id", "timestamp", "correlation_id", "event_type", "user_message", "assistant_response",
        F.array_join("sources_used", ",").alias("sources_used"), "latency_ms",
        meta("error", "escalation_reason").alias("detail"), meta("error_type", "escalation_type").alias("kind"),
        meta("kept").alias("kept"), F.get("tool_calls", 0)["success"].alias("success"),
    )


@query("audit_entries", _AUDIT_SQL)
def audit_entries(spark, sf_dir):
    return _flat_entries(_entries(spark, sf_dir))


@query("audit_round_trip", _AUDIT_SQL)
def audit_round_trip(spark, sf_dir):
    """Entries appended as JSON lines in two batches and read back."""
    path = scratch_dir(spark, "audit")
    entries = _entries(spark, sf_dir)
    late = F.col("timestamp") >= "2024-01-15"
    U.append_audit(entries.where(~late), path)
    U.append_audit(entries.where(late), path)
    return _flat_entries(read_audit(spark, path))


@query(
    "audit_session_scan",
    "SELECT CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'error' ELSE 'escalation' END AS event_type, "
    "'c-' || CAST(event_id AS VARCHAR) AS correlation_id FROM events WHERE user_id = 11",
)
def audit_session_scan(spark, sf_dir):
    return U.session_entries(_entries(spark, sf_dir), "11").select("event_type", "correlation_id")


@query(
    "audit_event_counts",
    "SELECT CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'error' ELSE 'escalation' END AS event_type, count(*) AS entries FROM events GROUP BY 1",
)
def audit_event_counts(spark, sf_dir):
    return U.event_counts(_entries(spark, sf_dir))


@query(
    "structured_log",
    f"""
    SELECT '{{"timestamp":"' || {_ISO} || '","level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","logger":"desk","message":"'
      || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"correlation_id":"c-' || CAST(event_id AS VARCHAR) || '"' ELSE '' END
      || ',"extra":{{"user_id":' || CAST(user_id AS VARCHAR) || '}}}}' AS record FROM events
    """,
)
def structured_log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "ts",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.lit("desk").alias("logger"),
        F.col("event_type").alias("message"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c-"), F.col("event_id").cast("string"))).alias("correlation_id"),
        "user_id",
    )
    return U.structured_log(rows, ["user_id"])
