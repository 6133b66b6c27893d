"""Maximal periodic runs of words, by seeds on the diagonals of each document and their extension.

A run of period *q* and length at least max(12, 2q) is a stretch of at least
max(12 - q, q) matches on diagonal *q* (words *q* apart).  Lags are therefore
served in layers: lags 1 to 11 by shared 6-grams, lags *k* to 2k - 1 by shared
*k*-grams for k = 12, 24, 48 and so on, the overlap that every run of the layer
has at the least.  All of it is exact: grams are named by rank, not by hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: the shortest run, and the overlap of seeds in the first layer
LEAST = 12
SEED = 6
#: words compared together; a longer text is compared alone
WORDS = 1 << 20


def _sorted_grams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by gram and then by place, and whether each begins another gram."""
    order = np.argsort(codes)
    codes, at = codes[order], at[order]
    new = np.concatenate(([True], codes[1:] != codes[:-1]))
    # places within a gram: one more sort, of numbers that hold gram and place
    gram = np.cumsum(new) - 1
    packed = np.sort((gram.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), new


class _Grams:
    """Names of the *k*-grams that occur more than once in their document; -1 for all others."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.doc = doc
        self.n = len(words)
        self.k = 1
        self.names = words

    def _keep(self, codes: np.ndarray, at: np.ndarray) -> None:
        self.at, self.new = _sorted_grams(codes, at)
        same = ~self.new[1:] & (self.doc[self.at[1:]] == self.doc[self.at[:-1]])
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        gram = np.cumsum(self.new) - 1
        self.names = np.full(self.n, -1, np.int64)
        self.names[self.at[again]] = gram[again]
        gram = gram[again]
        self.at = self.at[again]
        self.new = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, bool)

    def grow(self, by: int) -> None:
        """Grams longer by ``by``, at most their own length: each is two of the present ones that overlap or touch."""
        first, second = self.names[: self.n - by], self.names[by:]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        codes = (first[at].astype(np.uint64) << np.uint64(32)) | second[at].astype(np.uint64)
        self.k += by
        self._keep(codes, at) if len(at) else self._none()

    def _none(self) -> None:
        self.names = np.full(self.n, -1, np.int64)
        self.at, self.new = np.zeros(0, np.int64), np.zeros(0, bool)

    def start(self, k: int) -> None:
        """The first layer: grams of ``k`` words, three of which are told apart by one number where ids allow it."""
        words = self.names
        size = int(words.max(initial=0)) + 1
        if self.n < k:
            return self._none()
        if size < 1 << 21:
            code = (words[:-2].astype(np.uint64) << np.uint64(42)) | (words[1:-1].astype(np.uint64) << np.uint64(21))
            code |= words[2:].astype(np.uint64)
            at = self._recurring(code)
            self.k = 3
            self._keep(code[at], at) if len(at) else self._none()
        else:
            self.grow(1)
            self.grow(1)
        while self.k < k:
            self.grow(min(self.k, k - self.k))

    def _recurring(self, code: np.ndarray) -> np.ndarray:
        """Places whose gram may occur again in its document: all others have a cell of a count table to themselves."""
        own = (code ^ (self.doc[: len(code)].astype(np.uint64) << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        cell = (own >> np.uint64(42)).astype(np.int64)
        return np.flatnonzero(np.bincount(cell, minlength=1 << 22)[cell] > 1)


def _pairs(grams: _Grams, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(lag, place)`` of occurrences of one gram at lags from ``least`` to below twice its length.

    Occurrences at most half a gram apart form an arithmetic progression: the
    gram has that period, and the progression lies within a run of it.  Two
    occurrences of one progression only repeat that run, so neighbours alone
    are taken.  Of two progressions every lag is met by the last place of one
    with all places of the other, so pairs grow with the places, not with
    their square.  At most three progressions begin within a lag's reach.
    """
    at, new, k = grams.at, grams.new, grams.k
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.diff(at, prepend=at[0])
    head = new | (2 * gap > k)
    group = np.cumsum(head) - 1
    gram = np.cumsum(new) - 1
    firsts = np.flatnonzero(head)
    last = at[np.append(firsts[1:], len(at)) - 1]
    owner = gram[firsts]
    lags, places = [], []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        lag = y - x
        fits = (lag >= least) & (lag < 2 * k)
        lags.append(lag[fits])
        places.append(x[fits])

    inside = np.flatnonzero(~head)
    take(at[inside - 1], at[inside])
    for hop in (1, 2, 3):
        there = np.flatnonzero(group + hop < len(last))
        to = group[there] + hop
        there, to = (z[owner[to] == gram[there]] for z in (there, to))
        take(at[there], last[to])
        there = np.flatnonzero(group >= hop)
        to = group[there] - hop
        there, to = (z[owner[to] == gram[there]] for z in (there, to))
        take(last[to], at[there])
    return np.concatenate(lags), np.concatenate(places)


def _stretches(words: np.ndarray, lags: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of matches ``(lag, start, stop)`` around the seeds.

    Seeds are walked lag by lag in ascending order: one that begins within the
    stretch covered so far on its diagonal only moves its end.  What is left
    is extended to both sides, all stretches at once, in ever longer steps.
    """
    n = len(words)
    if not len(lags):
        return lags, lags, lags
    packed = np.unique(lags.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64))
    lag, at = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.ones(len(at), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + k)
    firsts = np.flatnonzero(head)
    lag, start, stop = lag[firsts], at[firsts], at[np.append(firsts[1:], len(at)) - 1] + k

    def grow(edge: np.ndarray, way: int) -> np.ndarray:
        """Move each edge while the words beyond it match."""
        open_, step = np.arange(len(edge)), 4
        edge = edge.copy()
        while len(open_):
            near = edge[open_, None] + (np.arange(step) if way > 0 else -1 - np.arange(step))
            far = near + lag[open_, None]
            held = (near >= 0) & (far < n)
            held[held] = words[near[held]] == words[far[held]]
            moved = np.where(held.all(1), step, held.argmin(1))
            edge[open_] += way * moved
            open_ = open_[moved == step]
            step = min(2 * step, max(4, (1 << 20) // max(1, len(open_))))
        return edge

    start, stop = grow(start, -1), grow(stop, 1)
    # seeds left of a gap may have grown into one stretch
    order = np.lexsort((start, lag))
    lag, start, stop = lag[order], start[order], stop[order]
    once = np.ones(len(lag), bool)
    once[1:] = (lag[1:] != lag[:-1]) | (start[1:] != start[:-1])
    return lag[once], start[once], stop[once]


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all maximal runs with their smallest periods, by start and then period.

    ``words`` are numbers from 0; ``doc`` numbers the document of each word,
    and documents are parted by one word of its own each.
    """
    grams = _Grams(words, doc)
    grams.start(SEED)
    found = []
    low = 1
    while len(grams.at):
        lag, start, stop = _stretches(words, *_pairs(grams, low), grams.k)
        length = stop - start + lag
        long = length >= np.maximum(least, 2 * lag)
        found.append((start[long], length[long], lag[long]))
        low = 2 * grams.k
        grams.grow(grams.k)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found))
    # a stretch that repeats with several periods has them as multiples of the smallest
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted_copy(doc_id: int | None, words: list) -> list:
    """The words of a document, repeated from a point on where the checksum of its id asks for it.

    With h = crc32 of the decimal id (0 without an id) and g = h // 10: where h
    is a multiple of ten, each word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(_RUN), pa.string()]


def _digest(runs: np.ndarray) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()).hexdigest()


def _rows(docs: list[tuple[int | None, list[bytes]]], with_runs: bool) -> list[tuple]:
    """The result rows of some documents, compared together."""
    sizes = np.array([len(w) for _, w in docs], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    coded = pa.array([w for _, own in docs for w in own], pa.large_binary()).dictionary_encode()
    # a word of its own ends each document
    words = np.empty(total, np.int64)
    ends = begins + sizes
    inner = np.ones(total, bool)
    inner[ends] = False
    words[inner] = coded.indices.to_numpy()
    words[ends] = len(coded.dictionary) + np.arange(len(docs))
    doc = np.repeat(np.arange(len(docs)), sizes + 1)
    start, length, period = find_runs(words, doc)

    # a word goes if a run holds it after the first period of that run
    depth = np.bincount(start + period, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)
    gone = np.cumsum(depth) > 0
    owner = doc[start]
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    rows = []
    for k, (doc_id, own) in enumerate(docs):
        at = begins[k]
        runs = np.stack([c[bounds[k] : bounds[k + 1]] for c in (start, length, period)], 1) - [[at, 0, 0]]
        if len(runs):
            s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
            best = (s, n, q, 1000 * n // q)
            own = [w for w, drop in zip(own, gone[at : at + len(own)].tolist()) if not drop]
        else:
            best = (None,) * 4
        kept = b" ".join(own)
        row = (doc_id, len(runs), *best, _digest(runs), hashlib.sha256(kept).hexdigest())
        if with_runs:
            row += ([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], kept.decode())
        rows.append(row)
    return rows


def periodic_runs(docs: DataFrame, planted: bool = False, with_runs: bool = False, words_at_once: int = WORDS) -> DataFrame:
    """Per document its maximal runs of repeated words, and its text without the repetitions.

    Returns ``doc_id, n_runs``, the longest run as ``start, length, period,
    exponent_milli`` (ties: the smallest start, then period; nulls without a
    run), ``runs_sha256`` over all runs and ``collapsed_sha256`` over the kept
    words joined by spaces; ``with_runs`` adds the ``runs`` themselves and the
    ``collapsed`` text.  Words are runs without ASCII white space, compared
    exactly.  A word is dropped if it lies in a run behind its first period.

    Null and empty texts have no words; rows are judged one by one, so
    repeated rows and ids give a row each, a null id is passed on; an empty
    table gives no rows; other columns are left aside.  Texts are compared in
    groups of about ``words_at_once`` words, a longer one by itself.
    ``planted`` first makes :func:`planted_copy` of the words.
    """
    names = _NAMES + ["runs", "collapsed"] * with_runs
    types = _TYPES[: len(names)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            columns = zip(*_rows(held, with_runs))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        held: list[tuple[int | None, list[bytes]]] = []
        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                words = planted_copy(doc_id, words) if planted else words
                if held and n + len(words) > words_at_once:
                    yield out(held)
                    held, n = [], 0
                held.append((doc_id, words))
                n += len(words) + 1
        if held:
            yield out(held)

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    ) + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * with_runs
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, schema)
