"""Context, prompt and fallback texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
CONTEXT_LIMIT = 1500
EXCERPT_LIMIT = 200
CONTEXT_SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "No relevant documents found in knowledge base."
DOCUMENT_HEADING = "### Retrieved Documentation ###\n"
TOOL_HEADING = "### Live Data from Tools ###"
QUERY_HEADING = "### User Query ###\n"
CITATION = r"\[(?:Source\s*)?(\d+)\]"
FALLBACK_FOUND = "I found relevant information in: "
FALLBACK_FOUND_END = (
    ". However, I encountered an issue generating a detailed response. "
    "Please try again or consult the documents directly."
)
FALLBACK_NONE = (
    "I couldn't find relevant information in the knowledge base for your query. "
    "Please rephrase or provide more details, or consider escalating to "
    "a human operator for assistance."
)
# --- end of fixed values ----------------------------------------------------

#: instructions for the answering model; pass your own text to replace it
DEFAULT_INSTRUCTIONS = (
    "Answer questions of network engineers from the documents and tool data below. "
    "Cite each fact as [Source N], use exact figures, say plainly what the sources do not cover, "
    "and mark whatever a person should look at."
)


def context_entry(rank: Column, source: Column, relevance: Column, content: Column) -> Column:
    """One retrieved document: a header with source and relevance, then its text cut at 1500."""
    body = F.when(
        F.length(content) > CONTEXT_LIMIT,
        F.concat(F.substring(content, 1, CONTEXT_LIMIT), F.lit("...")),
    ).otherwise(content)
    head = F.format_string("[Source %d: %s (relevance: %.2f)]\n", rank, source, relevance)
    return F.concat(head, body)


def context_text(entries: Column) -> Column:
    """Join context entries, or the fixed text when there are none."""
    empty = entries.isNull() | (F.size(entries) == 0)
    return F.when(empty, NO_CONTEXT).otherwise(F.array_join(entries, CONTEXT_SEPARATOR))


def tool_text(results: Column) -> Column:
    """Tool results (``array<map<string,string>>``) as numbered ``key: value`` blocks.

    Keys that start with an underscore are left out; no results give an empty text.
    """

    def block(result: Column, i: Column) -> Column:
        shown = F.filter(F.map_entries(result), lambda e: ~e["key"].startswith("_"))
        pairs = F.transform(shown, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]))
        title = F.concat(F.lit("Tool Result "), (i + 1).cast("string"), F.lit(":\n"))
        return F.concat(title, F.array_join(pairs, "\n"))

    blocks = F.concat(F.array(F.lit(TOOL_HEADING)), F.transform(results, block))
    empty = results.isNull() | (F.size(results) == 0)
    return F.when(empty, "").otherwise(F.array_join(blocks, "\n\n"))


def user_prompt(query: Column, context: Column, tool_data: Column) -> Column:
    """Documentation (if any), tool data (if any) and the query."""
    has_context = (F.length(context) > 0) & (context != NO_CONTEXT)
    return F.concat_ws(
        "\n\n",
        F.when(has_context, F.concat(F.lit(DOCUMENT_HEADING), context)),
        F.when(F.length(tool_data) > 0, tool_data),
        F.concat(F.lit(QUERY_HEADING), query),
    )


def system_context(region: Column, priority: Column, base: str = DEFAULT_INSTRUCTIONS) -> Column:
    """Base instructions plus the focus region and priority when known."""
    return F.concat(
        F.lit(base),
        F.when(region.isNotNull(), F.concat(F.lit("\nFocus region: "), region)).otherwise(""),
        F.when(priority.isNotNull(), F.concat(F.lit("\nPriority level: "), priority)).otherwise(""),
    )


def chat_messages(system: Column, history: Column, prompt: Column) -> Column:
    """``array<struct<role, content>>``: system text, history, then the prompt.

    ``history`` is an ordered array of at most a few such structs.
    """
    kind = "struct<role:string,content:string>"

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(kind)

    past = F.transform(
        F.coalesce(history, F.array().cast(f"array<{kind}>")),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")).cast(kind),
    )
    return F.concat(F.array(message("system", system)), past, F.array(message("user", prompt)))


def citations(text: Column) -> Column:
    """Cited numbers in order of appearance, as strings."""
    return F.regexp_extract_all(text, F.lit("(?U)" + CITATION), F.lit(1))


def fallback_text(sources: Column) -> Column:
    """Answer for a failed generation: names the first three sources, 50 characters each."""
    shown = F.array_join(F.transform(F.slice(sources, 1, 3), lambda s: F.substring(s, 1, 50)), ", ")
    found = F.concat(F.lit(FALLBACK_FOUND), shown, F.lit(FALLBACK_FOUND_END))
    return F.when(sources.isNull() | (F.size(sources) == 0), FALLBACK_NONE).otherwise(found)


def answer_confidence(n_sources: Column, n_tools: Column, mean_relevance: Column) -> Column:
    """0.3 with no grounding at all, else weighted source, tool and relevance parts, at most 1."""
    sources = F.least(n_sources / F.lit(3.0), F.lit(1.0)) * 0.5
    tools = F.least(n_tools / F.lit(2.0), F.lit(1.0)) * 0.3
    score = sources + tools + F.coalesce(mean_relevance, F.lit(0.0)) * 0.2
    return F.when((n_sources == 0) & (n_tools == 0), 0.3).otherwise(F.least(score, F.lit(1.0)))
