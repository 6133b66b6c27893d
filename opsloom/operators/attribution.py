"""Context for answers, and citations joined back to the documents they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.prompts import (
    EXCERPT_LIMIT, answer_confidence, chat_messages, citations, context_entry, context_text, tool_text, user_prompt,
)
from opsloom.functions.text import let
from opsloom.operators.skew import explode_rows

FALLBACK_DOCUMENTS = 3


def response_context(documents: DataFrame, key: str = "response_id", limit: int | None = None) -> DataFrame:
    """One formatted context per response from its ranked documents.

    ``documents``: key, rank, source_path, relevance, content.  A retrieval
    result is a top-k, so the group is small; ``limit`` cuts a longer list.
    """
    if limit is not None:
        documents = documents.where(F.col("rank") <= limit)
    entry = context_entry(F.col("rank"), F.col("source_path"), F.col("relevance"), F.col("content"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), entry.alias("entry"))))
    return documents.groupBy(key).agg(ordered.alias("__e")).select(
        key, context_text(F.transform("__e", lambda e: e["entry"])).alias("context")
    )


def attribute(responses: DataFrame, documents: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """Sources per response: key, position, document, relevance, excerpt.

    ``documents``: key, rank, source_path, relevance, content.  Cited numbers
    are ranks; numbers out of range are ignored and a source counts once, at
    its first citation.  A response that cites nothing usable, or has no text, is
    credited with its top three documents, without excerpts.

    Responses state the ranks they cite, and documents meet them by response,
    as a ranking leaves them: documents are not shuffled again, and row by row
    only those cited and the first three are kept.  What is then grouped per
    response is bounded by the citations in its text.
    """
    numbers = F.transform(citations(F.col(text)), lambda n: n.try_cast("bigint"))
    asked = responses.select(F.col(key).alias("__key"), F.array_distinct(numbers).alias("__cited"))
    # only the excerpt of a text travels on
    narrow = documents.select(
        key,
        F.col("rank").cast("bigint").alias("__rank"),
        F.col("source_path").alias("document"),
        "relevance",
        F.substring("content", 1, EXCERPT_LIMIT).alias("excerpt"),
    )
    # responses are as many as there are: never a table in every task, whatever their files' size suggests
    met = narrow.join(asked.hint("merge"), F.col(key) == F.col("__key"))
    at = F.nullif(F.array_position("__cited", F.col("__rank")), F.lit(0).cast("bigint"))
    used = met.withColumn("__pos", at).where(F.col("__pos").isNotNull() | F.col("__rank").between(1, FALLBACK_DOCUMENTS))
    entry = F.struct("__pos", "__rank", "document", "relevance", "excerpt")
    grouped = used.groupBy(key).agg(F.collect_list(entry).alias("__d"))

    def chosen(found: Column) -> Column:
        cited = F.sort_array(F.filter(found, lambda d: d["__pos"].isNotNull()))
        bare = F.transform(F.sort_array(found), lambda d: d.withField("excerpt", F.lit(None).cast("string")))
        return F.when(F.size(cited) > 0, cited).otherwise(bare)

    def named(listed: Column) -> Column:
        return F.struct(listed.alias("all"), F.transform(listed, lambda d: d["document"]).alias("names"))

    def once(n: Column) -> Column:
        return F.filter(n["all"], lambda d, i: F.array_position(n["names"], d["document"]) == i + 1)

    rows = explode_rows(grouped, [key], let(let(let(F.col("__d"), chosen), named), once), "__i", "d")
    return rows.select(key, (F.col("__i") + 1).alias("position"), "d.document", "d.relevance", "d.excerpt")


def confidence(responses: DataFrame, documents: DataFrame, tool_calls: DataFrame, key: str = "response_id") -> DataFrame:
    """Answer confidence per response from its documents and tool calls."""
    docs = documents.groupBy(key).agg(F.count("*").alias("__docs"), F.avg("relevance").alias("__relevance"))
    tools = tool_calls.groupBy(key).agg(F.count("*").alias("__tools"))
    joined = responses.select(key).join(docs, key, "left").join(tools, key, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        key,
        answer_confidence(
            F.coalesce("__docs", zero), F.coalesce("__tools", zero), F.col("__relevance")
        ).alias("confidence"),
    )


def build_messages(turns: DataFrame) -> DataFrame:
    """Add ``messages`` from system, history, query, context and tool_results columns."""
    prompt = user_prompt(F.col("query"), F.col("context"), tool_text(F.col("tool_results")))
    return turns.withColumn("messages", chat_messages(F.col("system"), F.col("history"), prompt))
