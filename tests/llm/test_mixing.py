"""Targets and samples against direct computations."""

import math
import random

import pytest

import corpora
from opsloom.llm import mixing
from opsloom.llm.shared import word_count

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    cleaned = (text or "").translate(str.maketrans(BLANK, " " * len(BLANK)))
    return len([w for w in cleaned.split(" ") if w])


def filled(sizes, share=1.5, most=2.0):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        spill = 0.0
        for s in sorted(open_, key=str):
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                spill += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = spill
    return target


def test_word_count(one):
    texts = [None, "", " \t", "one", " two  words\n", "a\x0bb\x0cc\rd", "non breaking stays", "x" * 50]
    assert one(word_count, *texts) == [words(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 10, 500, 10_000, 200_000]) for i in range(draw.randint(1, 12))} | {None: 70}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(rows).collect()}
    for source, target in filled(sizes).items():
        assert math.isclose(out[source], target, rel_tol=1e-9, abs_tol=1e-6)


def check(out, rows):
    sizes, taken, targets, longest = {}, {}, {}, {}
    source_of = {}
    for doc_id, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
        longest[source] = max(longest.get(source, 0), words(text))
        source_of.setdefault((doc_id, words(text)), source)
    for r in out:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
        targets[source] = r.target
    assert {s: pytest.approx(t) for s, t in filled(sizes).items()} == targets
    for source in taken:
        assert abs(taken[source] - targets[source]) <= longest[source]


def test_awkward_rows(spark):
    # ids and sizes tell the sources apart here
    check(mixing.mix(corpora.documents(spark)).collect(), [(r[0], r[1], r[3]) for r in corpora.rows()])


def test_hot_source_comes_near_its_target_again_and_again(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(["word"] * draw.randint(1, 40)), "en", "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = corpora.table(spark, *rows)
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(9)).collect()))
    check(mixing.mix(docs).collect(), [(i, t, s) for i, t, _, s in rows])


def test_whole_epochs_come_first(spark):
    docs = corpora.table(spark, *[(i, "one two three", "en", s) for i in range(60) for s in ("a",)], *[(100 + i, "x", "en", "b") for i in range(10)])
    out = mixing.mix(docs).collect()
    epochs = {("a" if r.doc_id < 100 else "b"): math.floor(r.target / r.source_size) for r in out}
    for r in out:
        base = epochs["a" if r.doc_id < 100 else "b"]
        assert r.repeats in (base, base + 1)


def test_heavier_documents_are_drawn_more_often(spark):
    rows = [(i, " ".join(["abcde" if i % 2 else "x" * 60] * 10), "en", "a") for i in range(4000)]
    out = mixing.mix(corpora.table(spark, *rows)).collect()
    extra = [sum(r.repeats - 1 for r in out if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert extra[1] > 2 * extra[0] > 0


def test_mixed_documents_repeat_whole_rows(spark):
    docs = corpora.documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    wanted = sum(r.repeats for r in mixing.mix(docs).collect())
    assert out.count() == wanted
    assert {r["size"] for r in out.collect()} == {"s"}


def test_empty_table_and_no_words(spark):
    assert mixing.mix(corpora.no_documents(spark)).collect() == []
    out = mixing.mix(corpora.table(spark, (1, None, None, None), (2, "", "en", "a"))).collect()
    assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
