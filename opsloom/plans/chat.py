"""A batch of chat turns through screening, retrieval, tools, answering and redaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from opsloom.functions import prompts as P
from opsloom.functions.guardrails import redact_output, validate_input
from opsloom.functions.intents import search_keywords
from opsloom.operators import attribution as A
from opsloom.operators import conversation as V
from opsloom.operators import intents as N
from opsloom.operators import retrieval as R
from opsloom.operators.embedding import EmbeddingProvider, embed_column
from opsloom.operators.tools import ToolRegistry
from opsloom.session import cut_lineage

#: adds a ``response`` column to turns with ``messages``; a null means the model failed
Responder = Callable[[DataFrame], DataFrame]


@dataclass
class ChatResult:
    """Frames keyed by ``response_id``."""

    rejected: DataFrame
    answers: DataFrame
    sources: DataFrame
    tool_results: DataFrame
    messages: DataFrame


def retrieve(turns: DataFrame, corpus: DataFrame, provider: EmbeddingProvider, top_k: int = R.TOP_K) -> DataFrame:
    """Ranked documents per turn: response_id, rank, relevance, method and the chunk.

    ``turns``: response_id, content, region.  A question and its keywords are
    probes, embedded in the tasks; any number of turns is searched together.  A
    turn with a region sees the chunks of that region only.
    """
    keywords = F.slice(search_keywords(F.col("content")), 1, R.MAX_KEYWORDS)
    region = F.when(F.col("region") != "", F.col("region")).alias("region")
    asked = turns.select("response_id", region, F.posexplode(F.concat(F.array("content"), keywords)).alias("probe", "text"))
    probes = cut_lineage(embed_column(asked, "text", provider).drop("text"), "questions")
    fetch = top_k * R.OVERFETCH
    near = R.nearest_to_each(probes, corpus, fetch, ["response_id", "probe"], "chunk_id", match="region")
    keyword = R.first_hits(near.where(F.col("probe") > 0), "response_id", fetch, "chunk_id")
    hits = R.fuse_ranks(near.where(F.col("probe") == 0), keyword, top_k, "chunk_id", "response_id")
    return corpus.join(hits, "chunk_id").select(
        "response_id", "rank", "relevance", "method", "chunk_id", "source_path", "content"
    )


def run_turns(
    turns: DataFrame,
    history: DataFrame,
    corpus: DataFrame,
    provider: EmbeddingProvider,
    registry: ToolRegistry,
    responder: Responder,
    instructions: str = P.DEFAULT_INSTRUCTIONS,
) -> ChatResult:
    """Answer a batch of turns: response_id, session_id, ts, content, region, priority.

    ``history`` holds earlier messages (session_id, ts, seq, role, content,
    sources, metadata).  Each session has at most one turn per batch.
    """
    checked = turns.withColumn("check", validate_input(F.col("content")))
    rejected = checked.where(~F.col("check.is_safe")).select(
        "response_id", F.concat(F.lit("Input validation failed: "), F.col("check.reason")).alias("detail")
    )
    accepted = cut_lineage(checked.where(F.col("check.is_safe")).drop("check"), "turns")

    # intents, with the topics of the session's last messages
    recent = V.newest_messages(history.join(accepted.select("session_id"), "session_id", "left_semi"), n=N.I.BOOST_WINDOW, tie="seq")
    topics = recent.groupBy("session_id").agg(F.collect_list(N.I.topic_flags(F.col("content"))).alias("recent"))
    available = [t["function"]["name"] for t in registry.list_tools()]
    intents = N.classify(accepted.join(topics, "session_id", "left").withColumn(
        "recent", F.coalesce("recent", F.array().cast(topics.schema["recent"].dataType))
    ), recent="recent", available_tools=available)
    calls = N.planned_calls(intents, "response_id").withColumn(
        "request_id", F.concat_ws(":", "response_id", "call_index")
    )
    calls = cut_lineage(calls.select("request_id", "response_id", "tool_name", "params"), "calls")
    results = registry.execute(calls.drop("response_id"))
    results = cut_lineage(results.join(calls.select("request_id", "response_id"), "request_id"), "tools")

    documents = cut_lineage(retrieve(accepted, corpus, provider), "retrieved")
    contexts = A.response_context(documents)
    # at most two calls per turn
    tool_maps = results.groupBy("response_id").agg(
        F.collect_list(F.create_map(F.lit("tool"), F.col("tool_name"), F.lit("data"), F.col("data"))).alias("tool_results")
    )
    ready = (
        accepted.join(contexts, "response_id", "left")
        .join(tool_maps, "response_id", "left")
        .join(V.prompt_history(history.withColumn("at", F.struct("ts", "seq")), order="at"), "session_id", "left")
        .withColumns(
            {
                "query": F.col("content"),
                "context": F.coalesce("context", F.lit(P.NO_CONTEXT)),
                "system": P.system_context(F.col("region"), F.col("priority"), instructions),
            }
        )
    )
    answered = responder(A.build_messages(ready)).select("response_id", "session_id", "ts", "query", "response")
    named = documents.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_path", "chunk_id"))).alias("d"))
    answered = answered.join(named, "response_id", "left").withColumn(
        "final", F.coalesce("response", P.fallback_text(F.transform("d", lambda d: d["source_path"])))
    )
    answered = cut_lineage(answered, "answers")

    sources = A.attribute(answered.where(F.col("response").isNotNull()), documents)
    sure = A.confidence(answered, documents, results)
    clean = answered.withColumn("r", redact_output(F.col("final")))
    answers = clean.join(sure, "response_id").select(
        "response_id", "session_id", F.col("r.text").alias("response"), "confidence", "r.pii_removed", "r.filtered_types"
    )
    finished = answered.select(
        "session_id",
        "ts",
        F.col("query").alias("user_message"),
        F.col("final").alias("reply"),
        F.transform("d", lambda d: d["chunk_id"]).alias("sources"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    return ChatResult(rejected, answers, sources, results, V.save_turns(history, finished))
