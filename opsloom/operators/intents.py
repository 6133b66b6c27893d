"""Intent classification of messages, with and without conversation context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions import intents as I
from opsloom.functions.text import let
from opsloom.operators.skew import explode_rows, lookback

AVAILABLE_TOOLS = [
    "network_health_check", "network_config", "ticket_creator", "ticket_query", "sla_monitor",
]


def classify(
    messages: DataFrame, text: str = "content", recent: str | None = None, available_tools: list[str] | None = None
) -> DataFrame:
    """Add category, confidence, entities, requires_tools, tool_calls and reasoning.

    ``recent`` names an array column with the topic flags of the last messages
    (see :func:`with_recent_topics`); it raises the confidence.
    """
    tools = AVAILABLE_TOOLS if available_tools is None else available_tools
    available = F.array(*[F.lit(t) for t in tools]) if tools else F.array().cast("array<string>")
    message = F.col(text)

    def judged(best: Column) -> Column:
        confidence = best["confidence"]
        if recent:
            confidence = F.least(confidence + I.topic_boost(best["category"], F.col(recent)), F.lit(1.0))
        return F.struct(best["category"].alias("category"), confidence.alias("confidence"))

    def planned(j: Column) -> Column:
        needed = I.requires_tools(j["category"], j["confidence"])
        names = F.when(needed, I.planned_tools(j["category"], available)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            j["category"].alias("category"), j["confidence"].alias("confidence"),
            I.extract_entities(message).alias("entities"), needed.alias("requires_tools"), names.alias("names"),
        )

    def complete(p: Column) -> Column:
        def call(tool: Column) -> Column:
            return F.struct(
                tool.alias("tool_name"),
                I.tool_parameters(tool, message, p["entities"]).alias("params"),
                I.tool_reason(tool, p["category"]).alias("reason"),
            )

        return F.struct(
            *[p[name].alias(name) for name in ("category", "confidence", "entities", "requires_tools")],
            F.transform(p["names"], call).alias("tool_calls"),
            I.reasoning_text(p["category"], p["entities"], p["names"]).alias("reasoning"),
        )

    intent = let(let(let(let(I.intent_scores(message), I.best_intent), judged), planned), complete)
    return messages.withColumn("__intent", intent).select(*messages.columns, "__intent.*")


def with_recent_topics(
    messages: DataFrame, session: str = "session_id", order: str = "ts", text: str = "content", output: str = "recent"
) -> DataFrame:
    """Add the topic flags of the four messages before each one in its session."""
    return lookback(messages, [session], order, I.topic_flags(F.col(text)), I.BOOST_WINDOW, output)


def category_in_context(
    messages: DataFrame, key: str, session: str = "session_id", order: str = "ts", text: str = "content"
) -> DataFrame:
    """Category and confidence of each message, raised by the four before it: key, category, confidence.

    Messages are judged where they lie; only scores and topic flags, no texts,
    are shuffled to their sessions.
    """
    message = F.col(text)
    judged = messages.select(
        key, session, order, let(I.intent_scores(message), I.best_intent).alias("__best"), I.topic_flags(message).alias("__flags")
    )
    seen = lookback(judged, [session], order, F.col("__flags"), I.BOOST_WINDOW, "__recent")
    raised = F.col("__best.confidence") + I.topic_boost(F.col("__best.category"), F.col("__recent"))
    return seen.select(key, F.col("__best.category").alias("category"), F.least(raised, F.lit(1.0)).alias("confidence"))


def planned_calls(classified: DataFrame, key: str) -> DataFrame:
    """One row per planned tool call: key, call_index, tool_name, params, reason."""
    return explode_rows(classified, [key], "tool_calls", "call_index", "__c").select(key, "call_index", "__c.*")
