"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds (multiplies)
its letters' vectors, each permuted by its place; a text bundles (adds) its
trigrams; a language bundles the texts it was learned from.  A text belongs to
the language with the largest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WIDTH = 1024
SEED = 7
#: about so many documents of a language are learned from, at most
SAMPLE_PER_LANG = 3000
UNKNOWN = "und"
#: cosines of unrelated vectors of this width lie within about 0.03
LEAST = 0.05
_SPACE = ord(" ")
#: symbols, documents and trigrams handled at once in a task
_SLICE, _DOCS, _GRAMS = 1 << 18, 256, 4096
#: fixed-point steps of a unit vector: sums of whole numbers do not depend on their order
_STEPS = 1 << 20


class Profiler:
    """Hypervectors of texts; letters and trigrams are drawn when first met."""

    def __init__(self, width: int = WIDTH, seed: int = SEED):
        self.width, self.seed = width, seed
        self.drawn: dict[int, np.ndarray] = {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.drawn:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.width)
            self.drawn[code] = (2 * bits - 1).astype(np.float32)
        return self.drawn[code]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One row per trigram code: its three letters bound by place."""
        places = [(codes >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
        letters, index = np.unique(np.concatenate(places), return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in letters])
        first, second, third = index.reshape(3, -1)
        return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case letters of all texts, other runs as one space, and the text each belongs to."""
        folded = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in folded])
        symbols = np.where(self.is_letter[codes], codes, _SPACE)
        keep = np.r_[True, (symbols[1:] != _SPACE) | (symbols[:-1] != _SPACE) | (owner[1:] != owner[:-1])]
        return symbols[keep].astype(np.int64), owner[keep]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The sum of each text's trigram vectors; zeros for a text without letters."""
        symbols, owner = self._symbols(texts)
        out = np.zeros((len(texts), self.width), np.float64)
        for at in range(0, max(len(symbols) - 2, 0), _SLICE):
            s, o = symbols[at : at + _SLICE + 2], owner[at : at + _SLICE + 2]
            codes, own = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:], o[:-2]
            inside = (own == o[2:]) & (s[1:-1] != _SPACE)
            distinct, index = np.unique(codes[inside], return_inverse=True)
            own = own[inside]
            if not len(own):
                continue
            low, high = own[0], own[-1] + 1
            for first in range(0, len(distinct), _GRAMS):
                some = distinct[first : first + _GRAMS]
                here = (index >= first) & (index < first + len(some))
                cell = (own[here] - low) * len(some) + index[here] - first
                counts = np.bincount(cell, minlength=(high - low) * len(some)).reshape(high - low, len(some))
                out[low:high] += counts.astype(np.float32) @ self.grams(some)
        return out

    def bundles(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """``bundle`` in groups of texts that are small together: first index and vectors."""
        start = 0
        while start < len(texts):
            end, total = start, 0
            while end < len(texts) and end - start < _DOCS and (end == start or total + len(texts[end]) <= 4 * _SLICE):
                total += len(texts[end])
                end += 1
            yield start, self.bundle(texts[start:end])
            start = end


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def held_out(doc_id: Column) -> Column:
    """A quarter of all ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE_PER_LANG, width: int = WIDTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of each language, from a bounded hash sample of labelled rows that are not held out.

    Of a language with more than ``sample`` rows, about ``sample`` are used.
    The result is one vector for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # one number for each language, like the prototypes below
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    n = F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair])[F.col("lang")]
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = known.where(share * n < sample)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, sums = Profiler(width, seed), {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for _, rows in profiler.bundles([t or "" for t in texts]):
                    steps = np.rint(_unit(rows) * _STEPS).astype(np.int64).sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + steps
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": list(sums.values())})

    partial = chosen.select("lang", "text").mapInPandas(summed, "lang string, sums array<long>")
    total = (
        partial.select("lang", F.posexplode("sums").alias("at", "steps"))
        .groupBy("lang", "at")
        .agg(F.sum("steps").alias("steps"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "steps")))["steps"].alias("steps"))
    )
    found = {row["lang"]: np.array(row["steps"], dtype=np.float64) for row in total.collect()}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], width: int = WIDTH, seed: int = SEED, names_out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (or ``names_out``), the cosine with that language cut to 0..1.

    Only the text is looked at.  Texts that are null or without letters, and
    all texts when nothing was learned, are ``und`` with score 0.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).T if names else np.zeros((width, 0))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(width, seed)
        for batch in batches:
            columns, texts = batch.columns[:-1], [t or "" for t in batch.columns[-1].to_pylist()]
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for start, rows in profiler.bundles(texts) if names else ():
                cosine = _unit(rows) @ matrix
                best = cosine.argmax(axis=1)
                some = np.flatnonzero(rows.any(axis=1))
                langs[start + some] = np.array(names, object)[best[some]]
                scores[start + some] = np.clip(cosine[some, best[some]], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*kept, *names_out])

    kept = [c for c in docs.columns if c not in names_out]
    rows = docs.select(*kept, F.col("text").alias("__text"))
    schema = docs.select(*kept).schema.add(names_out[0], "string").add(names_out[1], "double")
    return rows.mapInArrow(predicted, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows and predict every row: ``doc_id, held_out, lang_pred, score``.

    The prediction sees the text alone.  A null ``doc_id`` is never learned
    from nor held out; repeated rows are predicted alike; without any labelled
    row, or in an empty table, nothing is learned and all is ``und``.
    """
    prototypes = learn(docs)
    out = identify(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with a recognised language, columns unchanged; a null ``lang`` is filled in.

    Rejected are texts without letters and those whose cosine with every
    language is below ``least``: noise, not merely short or mixed texts.  Where
    no row has a language to learn from, nothing is rejected.
    """
    prototypes = learn(docs)
    if not prototypes:
        return docs
    found = identify(docs, prototypes, names_out=("__lang", "__score"))
    known = found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least))
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)
