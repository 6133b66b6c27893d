"""Audit events: five constructors, the JSON-lines sink, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
RESPONSE_LIMIT = 1000
MAX_FILE_BYTES = 100 * 1024 * 1024
EVENT_TYPES = ["query", "response", "tool_call", "error", "escalation"]
# --- end of fixed values ----------------------------------------------------

TOOL_CALL = (
    "struct<tool_name:string,parameters:map<string,string>,result_summary:string,latency_ms:double,"
    "success:boolean,error:string,timestamp:string>"
)
AUDIT_SCHEMA = (
    "session_id string, timestamp string, event_type string, user_message string, "
    f"assistant_response string, tool_calls array<{TOOL_CALL}>, sources_used array<string>, "
    "confidence_score double, latency_ms double, metadata map<string,string>, correlation_id string"
)
_FIELDS = {
    "user_message": "string",
    "assistant_response": "string",
    "tool_calls": f"array<{TOOL_CALL}>",
    "sources_used": "array<string>",
    "confidence_score": "double",
    "latency_ms": "double",
    "metadata": "map<string,string>",
    "correlation_id": "string",
}


def iso_time(ts: Column) -> Column:
    """ISO-8601 text with microseconds and a trailing Z; no fraction when it is zero."""
    ts = ts.cast("timestamp_ntz")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


_DEFAULTS = {
    "tool_calls": F.array,
    "sources_used": F.array,
    "latency_ms": lambda: F.lit(0.0),
    "metadata": F.create_map,
}


def _given(rows: DataFrame, name: str, default: Column | None = None) -> Column:
    if name in rows.columns:
        return F.col(name)
    return F.lit(None) if default is None else default


def _with_metadata(rows: DataFrame, extra: dict[str, Column]) -> Column:
    pairs = [part for name, value in extra.items() for part in (F.lit(name), value.cast("string"))]
    own = F.create_map(*pairs)
    if "metadata" not in rows.columns:
        return own
    given = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    # own keys win: drop them from the given map instead of relying on a session setting
    return F.map_concat(F.map_filter(given, lambda k, _: ~k.isin(list(extra))), own)


def _query_values(rows: DataFrame) -> dict[str, Column]:
    return {"user_message": F.col("message")}


def _response_values(rows: DataFrame) -> dict[str, Column]:
    values = {
        "assistant_response": F.substring("response", 1, RESPONSE_LIMIT),
        "sources_used": F.col("sources"),
        "confidence_score": F.col("confidence"),
        "latency_ms": F.col("latency_ms"),
    }
    return values | ({"tool_calls": F.col("tool_calls")} if "tool_calls" in rows.columns else {})


def _tool_call_values(rows: DataFrame) -> dict[str, Column]:
    told = ["tool_name", "parameters", "result_summary", "latency_ms", "success"]
    call = F.struct(*told, _given(rows, "error").cast("string").alias("error"), iso_time(F.col("ts")).alias("timestamp"))
    return {"tool_calls": F.array(call), "latency_ms": F.col("latency_ms")}


def _error_values(rows: DataFrame, error_type: str = "processing_error") -> dict[str, Column]:
    kind = _given(rows, "error_type", F.lit(error_type))
    return {"metadata": _with_metadata(rows, {"error": F.col("error"), "error_type": kind})}


def _escalation_values(rows: DataFrame, escalation_type: str = "human_handoff") -> dict[str, Column]:
    return {"metadata": _with_metadata(rows, {"escalation_reason": F.col("reason"), "escalation_type": F.lit(escalation_type)})}


_VALUES = {
    "query": _query_values,
    "response": _response_values,
    "tool_call": _tool_call_values,
    "error": _error_values,
    "escalation": _escalation_values,
}


def _entry(rows: DataFrame, event_type: Column, by_type: dict[str, dict[str, Column]]) -> DataFrame:
    """Common envelope; ``rows`` needs session_id and ts, and may bring correlation_id and metadata."""

    def field(name: str, dtype: str) -> Column:
        value = _DEFAULTS[name]() if name in _DEFAULTS else F.lit(None)
        if name in ("correlation_id", "metadata") and name in rows.columns:
            value = F.col(name)
        value = value.cast(dtype)
        for kind, values in by_type.items():
            if name in values:
                own = values[name].cast(dtype)
                value = own if len(by_type) == 1 else F.when(event_type == kind, own).otherwise(value)
        return value.alias(name)

    return rows.select(
        F.col("session_id").cast("string").alias("session_id"),
        iso_time(F.col("ts")).alias("timestamp"),
        event_type.alias("event_type"),
        *[field(name, dtype) for name, dtype in _FIELDS.items()],
    )


def query_events(rows: DataFrame) -> DataFrame:
    """From session_id, ts, message."""
    return _entry(rows, F.lit("query"), {"query": _query_values(rows)})


def response_events(rows: DataFrame) -> DataFrame:
    """From session_id, ts, response, sources, confidence, latency_ms and optional tool_calls."""
    return _entry(rows, F.lit("response"), {"response": _response_values(rows)})


def tool_call_events(rows: DataFrame) -> DataFrame:
    """From session_id, ts, tool_name, parameters, result_summary, latency_ms, success, error."""
    return _entry(rows, F.lit("tool_call"), {"tool_call": _tool_call_values(rows)})


def error_events(rows: DataFrame, error_type: str = "processing_error") -> DataFrame:
    """From session_id, ts, error; an ``error_type`` column replaces the default kind."""
    return _entry(rows, F.lit("error"), {"error": _error_values(rows, error_type)})


def escalation_events(rows: DataFrame, escalation_type: str = "human_handoff") -> DataFrame:
    """From session_id, ts, reason."""
    return _entry(rows, F.lit("escalation"), {"escalation": _escalation_values(rows, escalation_type)})


def events_of_all_kinds(rows: DataFrame, event_type: Column) -> DataFrame:
    """Entries of mixed rows in one pass; ``event_type`` names the constructor of each row.

    ``rows`` has the columns of all five constructors; each row's own ones count.
    """
    return _entry(rows, event_type, {kind: values(rows) for kind, values in _VALUES.items()})


def append_audit(entries: DataFrame, path: str, max_file_bytes: int = MAX_FILE_BYTES) -> None:
    """Append entries as JSON lines, one folder per day, in files of about ``max_file_bytes`` at most.

    Instead of renaming a full file, files are closed at the number of records
    that fill them (by the mean length of a record of this batch), and old days
    are whole folders.
    """
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    length = entries.agg(F.avg(F.octet_length(record))).first()[0] or 1.0
    (
        entries.withColumn("day", F.substring("timestamp", 1, 10))
        .write.mode("append")
        .partitionBy("day")
        .option("maxRecordsPerFile", max(1, int(max_file_bytes / (length + 1))))
        .option("ignoreNullFields", "false")
        .json(path)
    )


def session_entries(entries: DataFrame, session_id: str) -> DataFrame:
    """All entries of one session."""
    return entries.where(F.col("session_id") == session_id)


def event_counts(entries: DataFrame) -> DataFrame:
    """Entries per event type."""
    return entries.groupBy("event_type").agg(F.count("*").alias("entries"))


def structured_log(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Log records (ts, level, logger, message, correlation_id) as one JSON text per row.

    Fields without a value are left out; ``extra`` columns become a nested object.
    """
    fields = [
        iso_time(F.col("ts")).alias("timestamp"),
        F.col("level"),
        F.col("logger"),
        F.col("message"),
        F.col("correlation_id"),
    ]
    if extra:
        fields.append(F.struct(*extra).alias("extra"))
    return rows.select(F.to_json(F.struct(*fields)).alias("record"))
