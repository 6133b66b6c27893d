"""Fingerprints, links and groups against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpora
from opsloom.llm import simhash
from opsloom.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, wide=4):
    folded = (text or "").translate(FOLD)
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    words = [w for w in folded.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + wide]) for i in range(max(1, len(words) - wide + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[root(n)].add(n)
    return {n: frozenset(g) for g in groups.values() for n in g}


def test_seed_is_the_one_of_the_engine(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", seed=42)


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    groups = grouped(near, range(len(rows)))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    out = simhash.near_duplicates(corpora.documents(spark)).collect()
    assert sorted(map(tuple, out), key=str) == brute([(r[0], r[1]) for r in corpora.rows()])


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def clustered(seed, n=600):
    """Fingerprints within a few bits of some centres, and chains of them."""
    draw = random.Random(seed)
    out = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(n // 6):
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                at ^= 1 << bit
            out.add(at)
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 3, 16_384])
@pytest.mark.parametrize("seed", [0, 1])
def test_links_connect_exactly_what_is_near(spark, seed, bucket):
    prints = clustered(seed)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(p, p) for p in signed], "fp long, node long")
    links = simhash.fingerprint_links(rows, bucket=bucket).collect()
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) % (1 << 64)).count("1") <= 4]
    assert grouped([tuple(x) for x in links], signed) == grouped(near, signed)


def test_a_crowd_gives_a_forest_not_all_pairs(spark):
    draw = random.Random(3)
    prints = {sum(1 << b for b in draw.sample(range(64), 2)) for _ in range(900)}
    rows = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long").withColumn("node", F.col("fp"))
    links = simhash.fingerprint_links(rows)
    assert links.count() < 64 * len(prints)
    assert components(links).select("label").distinct().count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    nodes = list(range(400))
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(250)] + [(i, i + 1) for i in range(0, 120)] + [(399, i) for i in range(200, 390)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = spark.createDataFrame(edges, "a long, b long")
    out = {r.node: r.label for r in components(rows).collect()}
    groups = grouped(edges, {n for e in edges for n in e})
    assert out == {n: min(g) for n, g in groups.items()}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def sentence(draw, n):
    return [f"w{draw.randint(0, 5000)}" for _ in range(n)]


def test_near_copies_go_and_others_stay(spark):
    draw, rows, planted = random.Random(9), [], []
    for i in range(120):
        words = sentence(draw, draw.choice([60, 200, 400]))
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            changed = list(words)
            changed[draw.randrange(len(words))] = "changed"
            rows.append((1000 + i, " ".join(changed)))
            rows.append((2000 + i, " ".join(words).upper()))
            planted += [1000 + i, 2000 + i]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert set(range(120)) <= left
    assert len(left & set(planted)) <= len(planted) // 30


def test_the_second_fingerprint_is_independent():
    draw = random.Random(1)
    hashes = np.array([draw.getrandbits(64) for _ in range(500)], np.uint64)
    apart = (simhash.fingerprint(hashes) ^ simhash.fingerprint(simhash.rehashed(hashes))).bit_count()
    assert 16 < apart < 48


def test_one_of_each_of_awkward_rows(spark):
    docs = corpora.documents(spark)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    # 4, 5 and 6 have no words; 9 and both rows of 10 are one text
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids
    assert ids.count(9) == 1 and 10 not in ids and ids.count(11) == 2 and ids.count(None) == 2
    assert simhash.one_of_each(corpora.no_documents(spark)).count() == 0
    assert simhash.near_duplicates(corpora.no_documents(spark)).count() == 0


def test_long_filler_does_not_make_copies(spark):
    draw = random.Random(4)
    texts = [" ".join(sentence(draw, 100)) + filler for filler in (" 0" * 150, " a b c" * 400) for _ in range(4)]
    # only the number of repeats differs: a copy
    texts.append(texts[0] + " 0" * 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(range(8))


def rewritten(draw, words, share):
    """The words with runs of changed ones, so that about ``share`` of both shingle sets is common."""
    out, changed = list(words), round(len(words) * (1 - 2 * share / (1 + share)))
    at = draw.randrange(len(words) - changed)
    out[at : at + changed] = sentence(draw, changed)
    return out


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def near_nodes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("*", F.xxhash64("doc_id").alias("__r1"), F.xxhash64("text").alias("__r2"))
    nodes = simhash.shingle_sets(docs, 5, ("doc_id", "__r1", "__r2"), simhash.SKETCH)
    return docs, nodes.withColumn("first", F.struct("__r1", "__r2")).cache()


@pytest.mark.parametrize("bucket, block", [(16_384, 4_096), (8, 16)])
def test_no_pair_hides_behind_a_rejected_link(spark, bucket, block):
    draw = random.Random(11)
    # a crowd around one text, on both sides of the limit, and pairs just above it
    base = sentence(draw, 180)
    texts = [" ".join(rewritten(draw, base, draw.choice([0.74, 0.84, 0.9]))) for _ in range(100)]
    for _ in range(60):
        words = sentence(draw, 180)
        texts += [" ".join(words), " ".join(rewritten(draw, words, 0.815))]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    docs, nodes = near_nodes(spark, texts)
    of = {r.node: r.doc_id for r in nodes.collect()}
    links = [(of[r.a], of[r.b]) for r in simhash.near_links(nodes, docs, 5, 0.8, simhash.SKETCH, bucket, block).collect()]
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
    assert grouped(links, range(len(texts))) == grouped(near, range(len(texts)))


def test_long_texts_are_decided_by_all_their_shingles(spark):
    draw, texts = random.Random(13), []
    for i in range(60):
        words = sentence(draw, 900)
        texts += [" ".join(words), " ".join(rewritten(draw, words, 0.815 if i % 2 else 0.785))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    copies = {i + 1 for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8}
    assert 20 < len(copies) < 40 and left == set(range(len(texts))) - copies


def test_similarities_are_those_of_single_pairs():
    draw = random.Random(12)
    base = sentence(draw, 700)
    words = [base[: draw.choice([100, 300, 700])] for _ in range(10)] + [rewritten(draw, base, 0.8) for _ in range(10)]
    sketches = [simhash.sketch(simhash.shingle_hashes(" ".join(w), 5), 256) for w in words]
    parts = [np.frombuffer(s, "<u4") for s in sketches]
    lengths = np.array([len(p) for p in parts])
    padded = np.array([np.r_[p, np.full(256 - len(p), 2**32 - 1, np.uint32)] for p in parts])
    for one, part in zip(sketches, parts):
        value, _ = simhash.similarities(part, padded, lengths, 256)
        assert np.allclose(value, [simhash.similarity(one, s, 256) for s in sketches])


def test_similarity():
    def make(words):
        return simhash.sketch(simhash.shingle_hashes(" ".join(words), 5), 256)

    draw = random.Random(2)
    a = sentence(draw, 100)
    assert simhash.similarity(make(a), make(a), 256) == 1.0
    assert simhash.similarity(make(a), make(sentence(draw, 100)), 256) == 0.0
    # one word changed: 5 of 96 shingles differ on each side
    assert abs(simhash.similarity(make(a), make(a[:50] + ["x"] + a[51:]), 256) - 91 / 101) < 1e-9
    assert simhash.similarity(b"", b"", 256) == 1.0 and simhash.similarity(b"", make(a), 256) == 0.0
