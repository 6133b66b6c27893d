"""Conversation history: limits per session, turn saving, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.operators.skew import lookup

MAX_HISTORY = 50
CONTEXT_WINDOW = 10
PROMPT_HISTORY = 6


def _limited(messages: DataFrame, session: str, order: list[Column], n: int) -> DataFrame:
    # row_number <= n is cut per partition before the shuffle, so a session of
    # any size sends at most n rows per map task
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return messages.withColumn("__rn", rank).where(F.col("__rn") <= n).drop("__rn")


def oldest_messages(
    messages: DataFrame, session: str = "session_id", order: str = "ts", n: int = MAX_HISTORY, tie: str | None = None
) -> DataFrame:
    """The first ``n`` messages of each session (what a history read returns)."""
    return _limited(messages, session, [F.col(c).asc() for c in [order, *([tie] if tie else [])]], n)


def newest_messages(
    messages: DataFrame, session: str = "session_id", order: str = "ts", n: int = MAX_HISTORY, tie: str | None = None
) -> DataFrame:
    """The last ``n`` messages of each session (what pruning leaves)."""
    return _limited(messages, session, [F.col(c).desc() for c in [order, *([tie] if tie else [])]], n)


def session_history(messages: DataFrame, session_id, session: str = "session_id", order: str = "ts", n: int = MAX_HISTORY) -> DataFrame:
    """One session's first ``n`` messages in time order."""
    return messages.where(F.col(session) == session_id).orderBy(order).limit(n)


def prompt_history(
    messages: DataFrame, session: str = "session_id", order: str = "ts", n: int = PROMPT_HISTORY,
    role: str = "role", content: str = "content",
) -> DataFrame:
    """Per session the last ``n`` messages as an ordered array of role and content."""
    entry = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("content"))
    last = newest_messages(messages, session, order, n)
    grouped = last.groupBy(session).agg(F.sort_array(F.collect_list(entry)).alias("__m"))
    pairs = F.transform("__m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select(session, pairs.alias("history"))


def role_content(role: Column, content: Column) -> Column:
    """A message as a role and content pair."""
    return F.struct(role.alias("role"), content.alias("content"))


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two messages per finished turn: the user's, then the reply with its sources.

    ``turns``: session_id, ts, user_message, reply, sources, metadata.
    ``seq`` keeps the two in order, as they share one time stamp.
    """
    no_sources = F.array().cast("array<string>")
    no_metadata = F.create_map().cast("map<string,string>")
    pair = F.array(
        F.struct(
            F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("user_message").alias("content"),
            no_sources.alias("sources"), no_metadata.alias("metadata"),
        ),
        F.struct(
            F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("reply").alias("content"),
            F.coalesce("sources", no_sources).alias("sources"),
            F.coalesce("metadata", no_metadata).alias("metadata"),
        ),
    )
    return turns.select("session_id", "ts", F.inline(pair))


def save_turns(messages: DataFrame, turns: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """Messages after adding finished turns and pruning each session to ``n``."""
    return newest_messages(messages.unionByName(turn_messages(turns)), n=n, tie="seq")


def upsert_sessions(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert unknown sessions, move ``updated_at`` of known ones forward.

    ``seen``: session_id, ts.  One pre-aggregated pass, whatever the number of
    messages per session.
    """
    fresh = seen.select("session_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return (
        sessions.select("session_id", "created_at", "updated_at")
        .unionByName(fresh)
        .groupBy("session_id")
        .agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    )


def clear_sessions(rows: DataFrame, cleared: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows of all other sessions; use it on messages and on sessions alike."""
    return rows.join(cleared.select(session).distinct(), session, "left_anti")


def session_count(sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Number of distinct sessions; the distinct is pre-aggregated on the map side."""
    return sessions.agg(F.count_distinct(session).alias("session_count"))


def with_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session's times; safe for sessions of any size."""
    return lookup(messages, sessions, "session_id", ["created_at", "updated_at"])
