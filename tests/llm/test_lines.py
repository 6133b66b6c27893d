"""Line de-duplication against a direct count over all lines."""

import hashlib
import random
from collections import defaultdict

import pytest

import corpora
from opsloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_points=20, min_docs=3):
    """One (doc_id, n_lines, n_dropped, text) per row."""
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(FOLD)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_points:
                holders[key(line)].add(doc_id)
    keep = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if key(x) not in keep or keep[key(x)] == doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(docs, **limits):
    kept = lines.kept_lines(docs, lines.keep_bitmaps(docs, **limits))
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in kept.collect()], key=str)


@pytest.mark.parametrize("hot_share", [2, 1000])
def test_awkward_rows(spark, hot_share):
    docs = corpora.documents(spark)
    assert found(docs, hot_share=hot_share) == brute([(r[0], r[1]) for r in corpora.rows()])


@pytest.mark.parametrize("hot_share", [3, 50, 1000])
def test_random_lines_with_a_hot_one(spark, hot_share):
    draw = random.Random(hot_share)
    pool = [f"Line {i} of a POOL that is long enough é" for i in range(60)] + ["short"]
    rows = []
    for i in range(300):
        body = [draw.choice(pool) for _ in range(draw.randint(0, 150))]
        if i % 3 == 0:
            body.insert(0, "\tThe hot line of a third of all documents\r")
        rows.append((i % 280, "\n".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(docs, hot_share=hot_share) == brute(rows)


def test_bitmaps_are_sparse_words(spark):
    long = ["x" * 30 + str(i) for i in range(200)]
    rows = [(1, "\n".join(long)), (2, long[130]), (3, long[130])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bitmap = {r.doc_id: r for r in lines.keep_bitmaps(docs).collect()}
    assert set(bitmap) == {1, 2}
    assert [(w.word, w.bits) for w in bitmap[1].bitmap] == [(2, ~(1 << 2))]
    assert bitmap[1].n_dropped == 1


def test_stage_keeps_columns_and_documents(spark):
    docs = corpora.documents(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(corpora.rows())
    assert all(r.n_chars == len(r.text) and r["rank"] == "r" and r.version == "v" for r in rows)


def test_empty_table(spark):
    docs = corpora.no_documents(spark)
    assert found(docs) == [] and lines.dedup_lines(docs).count() == 0


def test_hash_of_kept_text(spark):
    from opsloom.llm.queries import op2  # the digest of the query is that of the text

    out = {r.doc_id: r for r in op2(spark, "/root/testdata/sf0.001").collect()}
    kept = lines.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert all(out[r.doc_id].kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in kept)
