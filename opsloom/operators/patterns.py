"""Texts against a table of patterns of any size.

Custom patterns are rows, not literals of a plan.  A pattern is tried on a text
only where the text holds all literals that every match of the pattern needs; one
automaton finds those literals for all patterns in a single pass over a text.
Patterns are then decided by Spark's own regular expressions, so the automaton
only saves work: it decides nothing.

Patterns that are plain words between white space need no expression: they are
looked up among the word sequences of a text, so that work grows with the texts
and their matches, not with texts times patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from opsloom.functions import guardrails as R
from opsloom.functions.text import UNICODE_NOCASE, fold
from opsloom.session import cut_lineage

#: characters of patterns that one pass holds (an automaton takes about a hundred times as many bytes)
PASS_CHARS = 2_000_000
#: a longer literal adds nothing: its first part is needed as well
LITERAL_CHARS = 64
#: bytes of texts that a task takes apart at a time (a longer text alone)
STEP_CHARS = 16_000_000
#: cells for each phrase: one sequence in about so many that are no pattern is looked up all the same
CELLS = 16
#: a table of phrases has ``2 ** MOST_BITS`` cells (32 MB) at most
MOST_BITS = 28
#: bits of a row of Spark's bitmaps
_BLOCK = 32_768
#: rows that a batch of phrases holds
_STEP = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: words of a pattern that is looked up as a phrase, at most
PHRASE_WORDS = 4
_PHRASE = rf"^\(\?<!\\S\)([A-Za-z0-9]+(?:\\s\+[A-Za-z0-9]+){{0,{PHRASE_WORDS - 1}}})\(\?!\\S\)$"
_ESCAPES_WITH_ARGUMENT = "xukNc0123456789QE"


def _close(pattern: str, at: int, opening: str, closing: str) -> int:
    """Place behind the bracket that closes the one at ``at``; brackets in classes and escapes do not count."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[" and opening != "[":
            at = _close(pattern, at, "[", "]") - 1
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    raise ValueError(f"unbalanced {opening} in pattern {pattern!r}")


def _atoms(pattern: str) -> Iterator[tuple[str | None, str]]:
    """Top-level parts of a pattern: a plain character (None for anything else) and its quantifier."""
    at = 0
    while at < len(pattern):
        c = pattern[at]
        plain: str | None = None
        if c == "\\":
            escaped = pattern[at + 1 : at + 2]
            at += 2
            if escaped in ("p", "P"):
                at = _close(pattern, at, "{", "}") if pattern[at : at + 1] == "{" else at + 1
            elif escaped == "" or escaped in _ESCAPES_WITH_ARGUMENT:
                raise ValueError("an escape that is not followed here")
            elif not escaped.isalnum():
                plain = escaped
        elif c == "[":
            if pattern.startswith(("[]", "[^]"), at):
                raise ValueError("a class that is not followed here")
            at = _close(pattern, at, "[", "]")
        elif c == "(":
            at = _close(pattern, at, "(", ")")
        elif c in "|)":
            raise ValueError("alternatives")
        else:
            plain = None if c in ".^$" or ord(c) > 127 else c
            at += 1
        quantifier = pattern[at : at + 1]
        if quantifier == "{":
            at = _close(pattern, at, "{", "}")
        elif quantifier in ("*", "+", "?") and quantifier:
            at += 1
        else:
            quantifier = ""
        if quantifier and pattern[at : at + 1] in ("?", "+"):
            at += 1
        yield plain, quantifier


def required_literals(pattern: str) -> list[str]:
    """The runs of ASCII characters that every match of a pattern holds, in lower case, each once.

    None where none is certain: alternatives at the top level, extended
    syntax, or no plain run.  Groups and classes end a run.
    """
    flags = pattern[2 : pattern.find(")")] if pattern.startswith("(?") else ""
    if "x" in flags and flags.replace("-", "").isalpha():
        return []
    runs = [""]
    try:
        for plain, quantifier in _atoms(pattern):
            if plain is None or quantifier in ("*", "?", "{"):
                runs.append("")
                continue
            runs[-1] += plain
            if quantifier == "+":
                # the character may repeat: what follows is not next to the run's start
                runs.append("")
    except ValueError:
        return []
    return list(dict.fromkeys(r.lower()[:LITERAL_CHARS] for r in runs if r))


def required_literal(pattern: str) -> str:
    """The longest of :func:`required_literals` (the first of several), or an empty text."""
    return max(required_literals(pattern), key=len, default="")


@pandas_udf(T.ArrayType(T.StringType()))
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literals)


def with_literals(patterns: DataFrame) -> DataFrame:
    """A pattern table (``pattern_id, pattern``, more columns allowed) with the ``literals`` of each pattern."""
    return patterns.where(F.col("pattern").isNotNull()).withColumn("literals", _literals("pattern"))


def _finder(needs: list[list[str]]):
    """Column function: the numbers of the literal lists of which a folded text holds all."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # a list is looked at where its longest literal occurs
        behind: dict[str, list[tuple[int, set[str]]]] = {}
        for i, words in enumerate(needs):
            if words:
                behind.setdefault(max(words, key=len), []).append((i, set(words)))
        always = [i for i, words in enumerate(needs) if not words]
        automaton = ahocorasick.Automaton()
        for word in {w for words in needs for w in words}:
            automaton.add_word(word, word)
        automaton.make_automaton()

        def of(text: str) -> list[int]:
            if not len(automaton):
                return always
            held = {word for _, word in automaton.iter(text)}
            return always + [i for word in held for i, words in behind.get(word, ()) if words <= held]

        for texts in batches:
            yield texts.map(of)

    return found.asNondeterministic()


def with_phrase(patterns: DataFrame) -> DataFrame:
    """A pattern table with the ``phrase`` of each pattern that is words between white space, else null."""
    words = F.split(F.lower(F.regexp_extract("pattern", _PHRASE, 1)), r"\\s\+")
    return patterns.withColumn("phrase", F.when(F.col("pattern").rlike(_PHRASE), F.array_join(words, " ")))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose last column, texts, holds about ``STEP_CHARS`` bytes in each, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        held = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, held + STEP_CHARS, "right")))
        yield batch.slice(at, end - at)
        at = end


class _Words:
    """The words of texts of words between single blanks, numbered, with the row of each."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, pattern=" ")
        told = pc.list_flatten(lists).dictionary_encode()
        self.rows = pc.list_parent_indices(lists).to_numpy()
        self.codes = told.indices.to_numpy().astype(np.int64)
        self.known = told.dictionary
        self.hashes = pd.util.hash_array(self.known.to_numpy(zero_copy_only=False), categorize=False)

    def starts(self, n: int) -> np.ndarray:
        """Places from which ``n`` words follow in one row."""
        last = len(self.codes) - n + 1
        return np.flatnonzero(self.rows[:last] == self.rows[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def cells(self, at: np.ndarray, n: int, bits: int) -> np.ndarray:
        """The cell of a table of ``2 ** bits`` in which the ``n`` words from each place lie."""
        found = np.zeros(len(at), np.uint64)
        for i in range(n):
            found = (found ^ self.hashes[self.codes[at + i]]) * _MIX
            found ^= found >> np.uint64(32)
        return ((found * _MIX) >> np.uint64(64 - bits)).astype(np.int64)

    def numbers(self, at: np.ndarray, n: int) -> np.ndarray:
        """A number for the ``n`` words from each place, the same for the same words."""
        found = self.codes[at]
        for i in range(1, n):
            found = np.unique(found * len(self.known) + self.codes[at + i], return_inverse=True)[1]
        return found

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.known.take(pa.array(self.codes[at + i])) for i in range(n)], " ")


def _counted(words: _Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places of ``n`` words: the first of each row and phrase, and how often the phrase comes there without overlap.

    Rows of a phrase follow each other, so that a shuffle compresses them.
    """
    rows = words.rows[at].astype(np.int64)
    group = words.numbers(at, n) * (int(rows.max(initial=0)) + 1) + rows
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    hits = np.diff(first, append=len(group))
    near = np.flatnonzero((np.diff(group) == 0) & (np.diff(at) < n))
    for g in np.unique(np.searchsorted(first, near, "right") - 1):
        count, end = 0, -1
        for place in at[first[g] : first[g] + hits[g]].tolist():
            if place >= end:
                count, end = count + 1, place + n
        hits[g] = count
    return at[first], hits


def _cells_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of the cells (:meth:`_Words.cells`) that phrases lie in, eight a byte and the lowest first."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch):
                words = _Words(run.column(0))
                begins = np.flatnonzero(np.diff(words.rows, prepend=-1))
                sizes = np.diff(begins, append=len(words.rows))
                cells = [words.cells(begins[sizes == n], int(n), bits) for n in np.unique(sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(cells)))], ["cell"])

    cells = phrases.select("phrase").mapInArrow(told, "cell long")
    place = F.col("cell") + 1
    blocks = cells.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(1 << bits, _BLOCK) // 8, np.uint8)
    # at most 2 ** (MOST_BITS - 3) bytes
    for block, held in blocks.collect():
        out[(block - 1) * _BLOCK // 8 : block * _BLOCK // 8] = np.frombuffer(bytes(held), np.uint8)
    return out


def _phrases(texts: DataFrame, key: list[str], text: Column, lengths: list[int], cells, bits: int) -> DataFrame:
    """``key, phrase, hits``: sequences of so many words, of those whose cell is set, and how often each comes in a text without overlap.

    Texts are of words between single blanks.  Some megabytes of them are
    taken apart at a time, whatever a batch holds, and their words are numbers
    in arrays; only sequences with a set cell become rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.value
        for batch in batches:
            for run in _runs(batch):
                words = _Words(run.column(run.num_columns - 1))
                for n in lengths:
                    at = words.starts(n)
                    cell = words.cells(at, n, bits)
                    at, hits = _counted(words, at[(held[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)], n)
                    for begin in range(0, len(at), _STEP):
                        part = at[begin : begin + _STEP]
                        rows = pa.array(words.rows[part])
                        own = [column.take(rows) for column in run.columns[:-1]]
                        yield pa.RecordBatch.from_arrays([*own, words.phrases(part, n), pa.array(hits[begin : begin + _STEP])], names)

    schema = texts.select(*key).schema.add("phrase", "string").add("hits", "long")
    names = schema.names
    return texts.select(*key, text.alias("__spaced")).mapInArrow(found, schema)


def _matching_phrases(texts: DataFrame, key: list[str], phrases: DataFrame) -> DataFrame:
    """:func:`matching_patterns` for patterns with a phrase; whether their table is broadcast is left to Spark's size check.

    Most sequences of words are no pattern, and a bitmap of bounded size that
    goes to every task tells so before they leave it.
    """
    size = F.size(F.split("phrase", " "))
    told = phrases.agg(F.count("*").alias("rows"), F.collect_set(size).alias("lengths")).first()
    spaced = F.btrim(F.regexp_replace(fold(F.col("__text")), r"(?U)\s+", " "))
    bits = min(MOST_BITS, (CELLS * told["rows"]).bit_length())
    cells = texts.sparkSession.sparkContext.broadcast(_cells_of(phrases, bits))
    each = _phrases(texts, key, spaced, sorted(told["lengths"]), cells, bits)
    return each.join(phrases, "phrase").select(*key, "pattern_id", "hits")


def matching_patterns(
    rows: DataFrame, key: list[str], text: str, patterns: DataFrame, pass_chars: int = PASS_CHARS
) -> DataFrame:
    """Which patterns occur in which texts: ``key`` columns, ``pattern_id`` and ``hits`` (number of matches).

    ``patterns`` has unique ``pattern_id`` and ``pattern``.  Matching ignores
    case in all scripts.  Null texts and null patterns match nothing, an empty
    text only what matches nothing at all; repeated rows and repeated patterns
    each give their own.  A table above ``pass_chars`` characters takes
    several passes over the texts, each with a part of the patterns, so that a
    task holds a bounded automaton and a broadcast stays bounded.  Patterns
    without a literal are tried on every text, and those of plain words
    (:func:`with_phrase`) on none.
    """
    known = cut_lineage(with_phrase(patterns.select("pattern_id", "pattern").where(F.col("pattern").isNotNull())), "patterns")
    texts = rows.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("__text"))
    phrases = known.where(F.col("phrase").isNotNull()).select("phrase", "pattern_id")
    others = known.where(F.col("phrase").isNull()).drop("phrase")
    out = None if phrases.isEmpty() else _matching_phrases(texts, key, phrases)
    if out is not None and others.isEmpty():
        return out
    table = with_literals(others).withColumn(
        "__chars", F.length("pattern") + F.lit(LITERAL_CHARS)
    )
    total = table.agg(F.coalesce(F.sum("__chars"), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-total // pass_chars))
    part = F.pmod(F.xxhash64("pattern_id"), F.lit(passes))
    for i in range(passes):
        some = table.where(part == i)
        # a part holds about pass_chars characters, whatever the size of the table
        needs = [r["literals"] for r in some.select("literals").distinct().orderBy("literals").collect()]
        numbers = rows.sparkSession.createDataFrame(list(enumerate(needs)), "__need int, literals array<string>")
        known = some.join(F.broadcast(numbers), "literals").select("pattern_id", "pattern", "__need")
        candidates = texts.withColumn("__found", _finder(needs)(fold(F.col("__text"))))
        tried = candidates.select(*key, "__text", F.explode("__found").alias("__need")).join(F.broadcast(known), "__need")
        hits = F.regexp_count("__text", F.concat(F.lit(UNICODE_NOCASE), F.col("pattern"))).cast("long")
        found = tried.select(*key, "pattern_id", hits.alias("hits")).where(F.col("hits") > 0)
        out = found if out is None else out.unionByName(found)
    return out


def screen_by_table(
    rows: DataFrame, key: str, text: str, patterns: DataFrame, max_length: int = R.MAX_MESSAGE_LENGTH
) -> DataFrame:
    """:func:`opsloom.functions.guardrails.validate_input` with its patterns as a table: ``key`` and the verdict.

    ``patterns`` has ``pattern_id``, ``pattern`` and ``kind`` (``injection`` or
    ``blocked``).  ``key`` is unique.  Only messages with a match are joined
    back, by their key.
    """
    within = rows.where(F.length(text).between(1, max_length))
    hits = matching_patterns(within, [key], text, patterns)
    kinds = patterns.select("pattern_id", "kind")
    flags = hits.join(kinds, "pattern_id").groupBy(F.col(key).alias("__key")).agg(
        F.bool_or(F.col("kind") == "injection").alias("__injection"), F.bool_or(F.col("kind") == "blocked").alias("__blocked")
    )
    verdict = R.validate_input(F.col(text), max_length, (), ())
    judged = rows.join(flags, F.col(key) == F.col("__key"), "left").withColumn("__v", verdict)

    def refused(reason: str, risk: float):
        return F.struct(
            F.lit(False).alias("is_safe"), F.lit(reason).alias("reason"), F.lit(risk).alias("risk_score")
        )

    final = (
        F.when(F.col("__injection"), refused(R.SAYS_INJECTION, 0.9))
        .when(F.col("__blocked"), refused(R.SAYS_BLOCKED, 0.8))
        .otherwise(F.col("__v"))
    )
    return judged.select(key, final.alias("v")).select(key, "v.*")
