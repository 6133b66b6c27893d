"""Text building blocks shared by the other function modules.

The character classes are written out (instead of ``\\w`` and ``\\s``) so that
accented letters count as letters on every JVM, and so that the same pattern
means the same thing to other regex engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: makes ``\b \w \\s \\d`` in a pattern cover all scripts
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"
#: one letter, digit or underscore, in any script
WORD = r"[\p{L}\p{N}_]"
#: one white-space character, in any script
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: the same white space, spelled out for trimming
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: one line end, in any convention
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it.

    Chains of such steps stay linear even where the optimizer copies a whole
    expression, for example to push a filter below it.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def nonempty(items: Column) -> Column:
    """Drop empty strings from an array."""
    return F.array_remove(items, "")


def tokens(text: Column) -> Column:
    """White-space separated tokens; an empty text has none."""
    return nonempty(F.split(text, SPACE + "+"))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their terminators; an empty text has none."""
    # nearly all texts end their lines with plain line feeds: no pattern needed
    unusual = text.rlike(r"[\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]")
    plain = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    body = F.regexp_replace(text, LINE_END + r"\z", "")
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(~unusual, F.split(plain, "\n"))
        .otherwise(F.split(body, LINE_END))
    )


def fold(text: Column) -> Column:
    """Lower case, with the four letters that fold to ASCII ones replaced first.

    A plain lower-case search on the result finds what a case-insensitive
    search finds in the original.
    """
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def count_newlines(text: Column) -> Column:
    """Number of line feeds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle occurs in ``text`` (plain substring search)."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def flag(condition: Column) -> Column:
    """A condition as 0/1, with unknown counted as 0."""
    return F.when(condition, 1).otherwise(0)


def count_flags(conditions: list[Column]) -> Column:
    """How many of the conditions hold."""
    total = flag(conditions[0])
    for condition in conditions[1:]:
        total = total + flag(condition)
    return total


def document_id(source_path: Column, content: Column) -> Column:
    """Stable id: 16 hex digits of SHA-256 over the path and the first 1000 characters."""
    head = F.concat(source_path, F.lit(":"), F.substring(content, 1, 1000))
    return F.substring(F.sha2(head, 256), 1, 16)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.concat(document_id, F.lit("_"), chunk_index.cast("string"))


def embedding_cache_key(text: Column, model: str) -> Column:
    """Cache key of a text under a model: fixed prefix, model hash, text hash."""
    model_part = F.substring(F.md5(F.lit(model)), 1, 8)
    text_part = F.substring(F.sha2(text, 256), 1, 32)
    return F.concat(F.lit("emb:v1:"), model_part, F.lit(":"), text_part)
