"""Profiles against their definition, and accuracy on rows that are never learned from."""

import random
import zlib

import numpy as np
import pytest

import corpora
from opsloom.llm import langid


def plain_bundle(profiler, text):
    """Gram by gram: every window of three symbols, letters bound by place."""
    symbols, last = [], None
    for c in f" {text.lower()} ":
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            symbols.append(c)
        last = c
    out = np.zeros(profiler.width)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b != " ":
            x, y, z = (profiler.letter(ord(s)).astype(float) for s in (a, b, c))
            out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_bundle_is_the_sum_of_its_grams():
    profiler = langid.Profiler(128)
    texts = ["Hello, World 12 again", "", "a", "12 !", "äöü ß ǅ İ", "日本語のテキスト", "x" * 700, " lead  and trail "]
    got = profiler.bundle(texts)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_bundle(profiler, text)), text


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(langid, "_SLICE", 50)
    monkeypatch.setattr(langid, "_GRAMS", 16)
    monkeypatch.setattr(langid, "_DOCS", 3)
    draw = random.Random(1)
    texts = ["".join(draw.choice("abc déf ") for _ in range(draw.choice([5, 60, 400]))) for _ in range(20)]
    profiler = langid.Profiler(64)
    got = np.zeros((20, 64))
    for start, rows in profiler.bundles(texts):
        got[start : start + len(rows)] = rows
    assert np.allclose(got, [plain_bundle(profiler, t) for t in texts])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and len(out) == docs.count()


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, langid.language_id(docs).collect())) == sorted(map(tuple, langid.language_id(other.repartition(5)).collect()))


def test_awkward_rows(spark):
    out = langid.language_id(corpora.documents(spark)).collect()
    assert len(out) == len(corpora.rows())
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id in (4, 5, 6, 7):
        assert (by_id[doc_id][0].lang_pred, by_id[doc_id][0].score) == ("und", 0.0)
    assert by_id[9][0].lang_pred == "de" and by_id[8][0].lang_pred == "en"
    assert not by_id[None][0].held_out
    assert by_id[10][0] == by_id[10][1]


def test_nothing_to_learn_from(spark):
    docs = corpora.table(spark, (1, "some text", None, "s"), (2, None, "en", "s"))
    assert {r.lang_pred for r in langid.language_id(docs).collect()} == {"und"}
    assert langid.language_id(corpora.no_documents(spark)).collect() == []


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = corpora.documents(spark)
    out = langid.known_language(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert not {4, 5, 6, 7} & set(ids) and ids.count(10) == 2 and ids.count(None) == 2
    assert all(r.lang is not None and r.score == "x" for r in rows)
    tables = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = [r.doc_id for r in tables.collect() if any(c.isalpha() for c in r.text)]
    assert langid.known_language(tables).count() >= 0.999 * len(letters)


@pytest.mark.parametrize("bound", [5, 50])
def test_the_sample_is_bounded_for_each_language(spark, bound):
    docs = corpora.table(spark, *[(i, f"text {i} in words", "en" if i % 10 else "de", "s") for i in range(2000)])
    learned = langid.learn(docs, sample=bound, width=64)
    assert set(learned) <= {"en", "de"} and "en" in learned
