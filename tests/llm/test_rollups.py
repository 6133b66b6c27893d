"""Totals against recounting, and batches sent more than once."""

import base64
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsloom.llm import queries, rollups
from opsloom.llm.packing import token_pieces
import corpora

CHANGE = "doc_id long, version string, before struct<source:string,lang:string,tokens:bigint>, after struct<source:string,lang:string,tokens:bigint>, batch string, source string"


def plain(df):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in df.collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "rollup")


def test_random_changes_equal_a_recount(spark, path):
    draw, live, wanted = random.Random(4), {}, Counter()
    for batch in range(5):
        changes = []
        for _ in range(80):
            doc, version = draw.randint(0, 40), draw.choice(["1", "2"])
            before = live.get((doc, version))
            after = None if before and draw.random() < 0.3 else (draw.choice(["a", "b", None]), draw.choice(["en", None]), draw.randint(0, 50))
            changes.append((doc, version, before, after, "clash", "clash"))
            live[doc, version] = after
        frame = spark.createDataFrame(changes, CHANGE)
        for _ in range(draw.randint(1, 3)):
            rollups.commit(path, f"batch-{batch}", frame.repartition(3))
    for (_, version), image in live.items():
        if image:
            wanted[image[0], image[1], version, "docs"] += 1
            wanted[image[0], image[1], version, "tokens"] += image[2]
    groups = {k[:3] for k in wanted}
    assert plain(rollups.totals(spark, path)) == {g: (wanted[*g, "docs"], wanted[*g, "tokens"]) for g in groups}


def test_a_batch_replaces_itself_only(spark, path):
    docs = corpora.documents(spark)
    rollups.commit(path, "one", rollups.inserted(docs, "v", F.lit(10)))
    first = plain(rollups.totals(spark, path))
    rollups.commit(path, "one", rollups.inserted(docs, "v", F.lit(10)))
    assert plain(rollups.totals(spark, path)) == first
    assert sum(n for n, _ in first.values()) == len(corpora.rows())
    rollups.commit(path, "two", rollups.revised(docs, "v", F.lit(10), F.lit(7)))
    rollups.commit(path, "two", rollups.revised(docs, "v", F.lit(10), F.lit(7)))
    assert plain(rollups.totals(spark, path)) == {k: (n, 7 * n) for k, (n, _) in first.items()}
    rollups.commit(path, "three", rollups.deleted(docs, "v", F.lit(7)))
    assert plain(rollups.totals(spark, path)) == {}


def test_null_counts_both_images_and_no_image(spark):
    changes = spark.createDataFrame(
        [(1, "v", None, ("a", "en", None), "", ""), (2, "v", ("a", "en", 3), ("b", "en", 4), "", ""), (3, "v", None, None, "", "")], CHANGE
    )
    assert plain(rollups.signed_totals(changes)) == {("a", "en", "v"): (0, -3), ("b", "en", "v"): (1, 4)}


def test_empty_batch(spark, path):
    rollups.commit(path, "one", rollups.inserted(corpora.documents(spark), "v", F.lit(1)))
    before = plain(rollups.totals(spark, path))
    rollups.commit(path, "two", rollups.inserted(corpora.no_documents(spark), "v", F.lit(1)))
    assert plain(rollups.totals(spark, path)) == before


def test_counts_of_a_subword_tokenizer(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = token_pieces(docs).groupBy("doc_id").agg(F.sum("length").alias("n"))
    counted = docs.join(counts, "doc_id")
    rollups.commit(path, "load", rollups.inserted(counted, "byte_bpe_50k", F.col("n")))
    out = plain(rollups.totals(spark, path))
    assert sum(t for _, t in out.values()) == counts.agg(F.sum("n")).first()[0]


def test_batch_corrected_to_nothing(spark, path):
    docs = corpora.documents(spark)
    rollups.commit(path, "b1", rollups.inserted(docs, "v", F.lit(10)))
    rollups.commit(path, "b2", rollups.inserted(docs.where("doc_id = 1"), "v", F.lit(3)))
    rollups.commit(path, "b1", rollups.inserted(docs.where("false"), "v", F.lit(10)))
    assert plain(rollups.totals(spark, path)) == {("a", "en", "v"): (1, 3)}


def test_query_equals_counting_each_document(spark):
    """All batches over a whole table, against both libraries text by text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    firsts = {}
    for d in docs:
        firsts[d.text or ""] = min(d.doc_id, firsts.get(d.text or "", d.doc_id))
    wanted = {}
    for d in docs:
        text = d.text or ""
        if firsts[text] != d.doc_id:
            continue
        rest = text.partition("\n")[2]
        n = {"byte_bpe_50k": len(exact.encode(rest, add_special_tokens=False).ids), "byte_bpe_multi_50k": len(multi.encode_ordinary(text))}
        for version, tokens in n.items():
            held = wanted.get((d.source, d.lang, version), (0, 0))
            wanted[d.source, d.lang, version] = (held[0] + 1, held[1] + tokens)
    assert plain(queries.QUERIES["op4_token_rollups"](spark, folder)) == wanted


def test_token_counts_of_awkward_texts(spark):
    docs = spark.createDataFrame(
        [(None, None, "k"), (1, "", "k"), (1, "", "k"), (2, "x" * 200_000, "k"), (3, "<|endoftext|> \u4e2d\u6587", "k")],
        "doc_id long, text string, tokens string",
    )
    counts = {"n": ("text", "byte_bpe_50k.json"), "m": ("text", "byte_bpe_multi_50k.tiktoken")}
    one = rollups.counter("byte_bpe_50k.json")
    out = sorted((r.n, r.m > 0, r.tokens) for r in rollups.token_counts(docs, ["doc_id", "tokens"], counts).collect())
    assert out == sorted([(0, False, "k")] * 3 + [(one("x" * 200_000), True, "k"), (one("<|endoftext|> \u4e2d\u6587"), True, "k")])
    assert rollups.token_counts(docs.where("false"), ["doc_id"], counts).count() == 0
