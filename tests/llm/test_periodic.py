"""Periodic runs against a comparison of all words at all lags."""

import hashlib
import random
import re
import zlib

import pytest

import corpora
from opsloom.llm import periodic


def runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in out.items())


def brute(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(runs(words), key=lambda r: (r[0], r[2]))
    gone = {t for s, length, q in found for t in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept))


def random_text(draw):
    kind = draw.random()
    n = draw.randint(0, 160)
    words = [draw.choice("abcdefghijklmnop"[: draw.choice([1, 2, 2, 3, 16])]) for _ in range(n)]
    if kind < 0.5 and n > 8:
        for _ in range(draw.randint(1, 3)):
            at = draw.randrange(n)
            p, end = draw.randint(1, max(1, (n - at) // 2)), draw.randint(at, n)
            for i in range(at, end):
                words[i] = words[at + (i - at) % p]
    elif kind < 0.6:  # strings with many runs of many periods
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        words = y[:n]
    elif kind < 0.7:
        words = (["a", "b"] * 5 + ["a"]) * 2 + ["b"] + words
    return draw.choice([" ", "\n", "\t \x0b"]).join(words)


@pytest.mark.parametrize("at_once", [50, periodic.WORDS])
def test_random_texts(spark, at_once):
    draw = random.Random(at_once)
    rows = [(i, random_text(draw), "en", "a") for i in range(400)]
    docs = corpora.table(spark, *rows).repartition(3)
    out = periodic.periodic_runs(docs, planted=True, words_at_once=at_once).collect()
    assert sorted(map(tuple, out)) == sorted(brute(r[0], r[1]) for r in rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in corpora.rows()]
    out = periodic.periodic_runs(corpora.documents(spark)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(brute(i, t, planted=False)) for i, t in rows)
    assert periodic.periodic_runs(corpora.no_documents(spark)).collect() == []


def test_one_word_many_times_and_a_long_period(spark):
    many = " ".join(["x"] * 60_000)
    period = " ".join(f"w{i}" for i in range(5_000))
    docs = corpora.table(spark, (1, many, "en", "a"), (2, " ".join([period] * 3 + ["w0"]), "en", "a"))
    out = {r.doc_id: r for r in periodic.periodic_runs(docs, with_runs=True).collect()}
    assert [tuple(r) for r in out[1].runs] == [(0, 60_000, 1)] and out[1].collapsed == "x"
    assert [tuple(r) for r in out[2].runs] == [(0, 15_001, 5_000)] and out[2].collapsed == period


def test_pairs_grow_with_the_words():
    """Seeds of a text of one word stay in proportion to it, not to its square."""
    import numpy as np

    words = np.append(np.zeros(4_000, np.int64), 1)
    grams = periodic._Grams(words, np.zeros(len(words), np.int64))
    grams.start(periodic.SEED)
    lags, _ = periodic._pairs(grams, 1)
    assert len(lags) < len(words)


def test_many_distinct_words():
    """Word numbers too large for three in one number are named pair by pair."""
    import numpy as np

    words = np.array([*range(3_000_000, 3_000_040), *([7, 8, 2_500_000] * 6), 9])
    start, length, period = periodic.find_runs(words, np.zeros(len(words), np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([40], [18], [3])


def test_query_on_given_texts(spark):
    from opsloom.llm.queries import op12

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 2_500}
    out = {r.doc_id: tuple(r) for r in op12(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(rows) and len(short) > 100
    assert all(out[i] == brute(i, t) for i, t in short.items())
    assert any(out[i][1] for i in short)
