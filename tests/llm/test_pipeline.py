"""The five stages, one after the other, on planted cases."""

import random

import corpus_pipeline
from opsloom.llm import packing
import corpora

SF = "/root/testdata/sf0.001"


def planted(spark):
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("the", "word", "mend", "lor", "sing", "tree") for b in ("ing", "er", "s", "ly", "ed")]
    passage = "this very passage stands in many documents of the corpus"

    def text(n):
        return " ".join(draw.choice(vocabulary) + draw.choice(vocabulary) for _ in range(n))

    rows, clean = [], []
    for i in range(200):
        body = text(draw.choice([40, 90, 300]))
        rows.append((i, f"{body}\n{passage}", "en", f"s{i % 4}"))
        clean.append(i)
        if i % 10 == 0:
            rows.append((1000 + i, f"{body}\n{passage}", "en", "s0"))
    rows += [(2000, "12345 67890 !!", "en", "s1"), (2001, None, None, None), (2002, "", "en", "s2")]
    return corpora.table(spark, *rows), set(clean)


def test_stages(spark):
    docs, clean = planted(spark)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        left[name] = [r.doc_id for r in docs.collect()]
        assert name == "packing" or docs.columns == columns
        if name == "line_dedup":
            assert sum("this very passage" in r.text for r in docs.collect()) == 1
    assert not {2000, 2001, 2002} & set(left["language_id"]) and clean <= set(left["language_id"])
    assert left["line_dedup"] == sorted(left["language_id"]) or sorted(left["line_dedup"]) == sorted(left["language_id"])
    kept = set(left["near_dedup"])
    assert clean <= kept and not any(i >= 1000 for i in kept)
    assert set(left["mixing"]) <= kept and len(left["mixing"]) > len(kept)
    assert set(left["packing"]) == set(left["mixing"])


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    by_stage = sorted(map(tuple, docs.select(*pieces).collect()))
    assert by_stage == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*pieces).collect()))
    rows = docs.collect()
    assert len({r.sequence_id for r in rows}) >= -(-sum(r.length for r in rows) // packing.CAPACITY)
