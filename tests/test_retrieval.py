import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.functions.vectors import MAX_PROBES, cosine_similarity, probe_scores
from opsloom.operators import retrieval as R


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    return rng.normal(size=(300, 8))


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(f"c{i:03d}", [float(x) for x in v], "north" if i % 3 else "south", f"/kb/{i % 5}.md") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, region string, source_path string")


def _cosines(vectors, probe):
    f = vectors.astype("float32").astype("float64")
    s = f @ probe / np.linalg.norm(f, axis=1) / np.linalg.norm(probe)
    return np.round(np.maximum(s, 0), 6)


def _top(vectors, probe, k, keep=None):
    s = _cosines(vectors, probe)
    ids = [i for i in range(len(s)) if keep is None or keep(i)]
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def test_top_k_equals_brute_force(corpus, vectors):
    probe = vectors[5] * 3
    got = [r.chunk_id for r in R.vector_top_k(corpus, list(probe), 10, "chunk_id").orderBy("rank").collect()]
    assert got == [f"c{i:03d}" for i in _top(vectors, probe, 10)] and got[0] == "c005"


def test_filter_comes_before_ranking(corpus, vectors):
    wanted = R.metadata_filter(corpus, {"region": "south", "source_path": "3.md", "other": 1})
    got = [r.chunk_id for r in R.vector_top_k(wanted, list(vectors[0]), 5, "chunk_id").orderBy("rank").collect()]
    assert got == [f"c{i:03d}" for i in _top(vectors, vectors[0], 5, lambda i: i % 3 == 0 and i % 5 == 3)]
    assert R.metadata_filter(corpus, None) is corpus and R.metadata_filter(corpus, {"x": 1}) is corpus


def test_odd_vectors_are_skipped(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0]), ("e", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {r.id: r.similarity for r in R.vector_top_k(df, [2.0, 0.0], 5, "id").collect()}
    assert got == {"a": 1.0, "d": 0.0, "e": 0.0}


@pytest.mark.parametrize("blocks", [(8192, 512), (50, 20)])
def test_any_number_of_questions(spark, corpus, vectors, monkeypatch, blocks):
    monkeypatch.setattr(R, "CORPUS_BLOCK", blocks[0])
    monkeypatch.setattr(R, "PROBE_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    probes = rng.normal(size=(700, 8))
    rows = [(f"q{i}", [float(x) for x in v], [None, "north", "south", "nowhere"][i % 4]) for i, v in enumerate(probes)]
    rows += [("null", None, None), ("narrow", [1.0], None)]
    asked = spark.createDataFrame(rows, "q string, embedding array<double>, region string")
    got = {}
    for r in R.nearest_to_each(asked, corpus, 4, ["q"], "chunk_id", match="region").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.chunk_id)
    allowed = [lambda i: True, lambda i: i % 3, lambda i: i % 3 == 0, lambda i: False]
    want = {f"q{i}": [f"c{j:03d}" for j in _top(vectors, v, 4, allowed[i % 4])] for i, v in enumerate(probes)}
    assert got == {q: ids for q, ids in want.items() if ids}


def test_copies_for_many_questions_stay_few():
    blocks, turns = R._blocks((615_384, 64), (615_384, 64), 12)
    assert blocks < 25 and turns < 25
    # blocks of wide vectors hold no more numbers, and a small table still fills the cores
    blocks, turns = R._blocks((100_000, 4096), (100_000, 4096), 12)
    assert 100_000 * 4096 / blocks <= R.BLOCK_NUMBERS and turns == blocks
    blocks, turns = R._blocks((10_256, 64), (10_256, 64), 12)
    assert blocks * turns >= 20


def test_nearest_pairs_over_many_tiles(monkeypatch):
    from opsloom.functions import vectors as V

    monkeypatch.setattr(V, "PROBE_TILE", 7)
    monkeypatch.setattr(V, "ROW_TILE", 10)
    rng = np.random.default_rng(5)
    # few distinct directions: most similarities are ties, many are zero, some tiles are copies of one vector
    rows = [rng.integers(-1, 2, 3).astype("float32") for _ in range(90)] + [np.ones(3, "float32")] * 40
    rows += [None, np.array([1.0]), np.array([np.nan, 1.0, 1.0]), np.array([np.inf, 0.0, 0.0])]
    asking = rows[60:]
    got = {}
    for probe, row, similarity in zip(*V.nearest_pairs(pd.Series(asking), pd.Series(rows), 4, 6)):
        got.setdefault(probe, []).append((row, similarity))
    for i, a in enumerate(asking):
        scored = []
        for j, b in enumerate(rows):
            if a is not None and b is not None and len(a) == len(b) and np.isfinite(a).all() and np.isfinite(b).all():
                norms = np.linalg.norm(a.astype("float64")) * np.linalg.norm(b.astype("float64"))
                scored.append((-max(round(float(a @ b) / norms, 6), 0.0) if norms else 0.0, j))
        want = sorted((round(s, 6), j) for s, j in scored)[:4]
        assert [row for row, _ in got.get(i, [])] == [j for _, j in want], i
        assert [similarity for _, similarity in got.get(i, [])] == pytest.approx([-s for s, _ in want])


def test_probes_of_the_caller_in_blocks(corpus, vectors):
    probes = [(i, list(vectors[i % 300])) for i in range(MAX_PROBES + 90)]
    got = R.multi_probe_top_k(corpus, probes, 1, "chunk_id").collect()
    assert {(r.probe, r.chunk_id) for r in got} == {(i, f"c{i % 300:03d}") for i, _ in probes}


def test_bm25_uses_all_terms(spark):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(9)], "id int, content string")
    got = R.bm25_top_k(docs, [f"w{i}" for i in range(9)], 9, "id").collect()
    assert {r.id for r in got} == set(range(9))


def test_probe_count_is_checked(corpus):
    with pytest.raises(ValueError):
        probe_scores(F.col("embedding"), [[1.0] * 8] * (MAX_PROBES + 1))
    wide = corpus.select("chunk_id", F.explode(F.array(F.lit(1), F.lit(2))), "embedding")
    with pytest.raises(ValueError):
        R.read_probes(wide, "chunk_id", "embedding")


def test_many_probes_equal_single_ones(corpus, vectors):
    probes = [(i, list(vectors[i])) for i in range(5)] + [(5, [0.0] * 8)]
    got = {}
    for r in R.multi_probe_top_k(corpus.repartition(7), probes, 4, "chunk_id").collect():
        got.setdefault(r.probe, {})[r["rank"]] = r.chunk_id
    for i in range(5):
        assert [got[i][n] for n in range(1, 5)] == [f"c{j:03d}" for j in _top(vectors, vectors[i], 4)]
    # a zero probe scores zero everywhere: ids decide the tie
    assert [got[5][n] for n in range(1, 5)] == ["c000", "c001", "c002", "c003"]


def test_search_many_equals_single_searches(corpus, vectors):
    questions = [(f"q{i}", list(vectors[i]), [list(vectors[i + 10]), list(vectors[i + 20])]) for i in range(3)] + [("bare", list(vectors[9]), [])]
    many = R.search_many(corpus, questions, 4)
    for name, probe, keywords in questions:
        single = R.hybrid_search(corpus, probe, keyword_vectors=keywords, top_k=4).orderBy("rank")
        got = many.where(F.col("question") == name).orderBy("rank").drop("question")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in single.collect()], name


def test_column_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    a, b = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert a == pytest.approx(0.5**0.5) and b is None


def _fuse(semantic, keyword, k):
    scores, order = {}, []
    for weight, leg in ((0.7, semantic), (0.3, keyword)):
        for rank, doc in enumerate(leg, 1):
            if doc not in scores:
                order.append(doc)
            scores[doc] = scores.get(doc, 0) + weight / (60 + rank)
    best = sorted(order, key=lambda d: -round(scores[d], 12))[:k]
    return [(d, round(min(scores[d] * 10, 1), 6), "hybrid" if d in semantic and d in keyword else "semantic" if d in semantic else "keyword") for d in best]


@pytest.mark.parametrize("semantic, keyword", [(["a", "b", "c"], ["c", "d"]), ([], ["x", "y"]), (["p"], []), (["a", "b"], ["b", "a"])])
def test_fusion(spark, semantic, keyword):
    def leg(ids):
        return spark.createDataFrame([(d, i) for i, d in enumerate(ids, 1)], "id string, rank int")

    got = [(r.id, r.relevance, r.method) for r in R.fuse_ranks(leg(semantic), leg(keyword), 3, "id").orderBy("rank").collect()]
    assert got == _fuse(semantic, keyword, 3)


def test_best_possible_relevance(spark):
    leg = spark.createDataFrame([("a", 1)], "id string, rank int")
    assert R.fuse_ranks(leg, leg, 1, "id").first().relevance == pytest.approx(10 / 61, abs=1e-6)


def test_first_keyword_fixes_the_score(spark):
    df = spark.createDataFrame([("a", [1.0, 0.2]), ("b", [0.1, 1.0]), ("c", [0.5, 0.5])], "id string, embedding array<float>")
    got = {r.id: r for r in R.keyword_vector_leg(df, [[1.0, 0.0], [0.0, 1.0]], 3, "id").collect()}
    # both keywords fetch b; it keeps the low score of the first
    assert got["b"].similarity == pytest.approx(0.1 / 1.01**0.5, abs=1e-6) and got["b"].rank == 3


def test_semantic_only_and_hybrid(corpus, vectors):
    only = R.hybrid_search(corpus, list(vectors[1]), keyword_vectors=[list(vectors[2])], top_k=3, semantic_only=True).collect()
    assert {r.method for r in only} == {"semantic"} and len(only) == 3
    both = R.hybrid_search(corpus, list(vectors[1]), keyword_vectors=[list(vectors[1])], top_k=3).collect()
    assert {r.method for r in both} == {"hybrid"}


def test_bm25_prefers_rare_terms(spark):
    rows = [(i, "common words about links" if i else "common rareterm") for i in range(20)] + [(20, "nothing")]
    df = spark.createDataFrame(rows, "id int, content string")
    got = R.bm25_top_k(df, ["rareterm", "common", "COMMON"], 5, "id").orderBy("rank").collect()
    assert got[0].id == 0 and len(got) == 5 and 20 not in {r.id for r in got}
    assert R.bm25_top_k(df, ["absent"], 5, "id").count() == 0


def test_postings_equal_the_scan_and_read_their_terms_only(spark, tmp_path):
    from opsloom.operators import postings

    rows = [(i, f"common w{i % 7} w{i % 11} W{i % 5}" + " common" * (i % 3)) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "id int, content string")
    path = str(tmp_path / "index")
    postings.write_postings(docs, path, "id")
    for terms in (["common"], ["w1", "W2", "w3", "nowhere"], [f"w{i}" for i in range(11)]):
        got = postings.bm25_from_postings(spark, path, terms, 12, "id")
        want = R.bm25_top_k(docs.fillna(""), terms, 12, "id")
        assert sorted(map(tuple, got.select("id", "score", "rank").collect())) == sorted(map(tuple, want.select("id", "score", "rank").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_terms_are_counted_in_their_rows_without_a_shuffle(spark):
    from opsloom.functions.text import tokens
    from opsloom.operators.postings import term_counts

    rows = [(1, "a b a"), (2, ""), (3, None), (1, "b b b"), (None, "c")]
    docs = spark.createDataFrame(rows, "id long, content string")
    counts = term_counts(docs, "id", tokens(F.col("content")))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.id, r.length, r.term, r.tf) for r in counts.collect()), key=str)
    wanted = [(1, 3, None, None), (1, 3, "a", 2), (1, 3, "b", 1), (2, 0, None, None), (3, None, None, None)]
    wanted += [(1, 3, None, None), (1, 3, "b", 3), (None, 1, None, None), (None, 1, "c", 1)]
    assert got == sorted(wanted, key=str)
