"""Token files: exact round trips, random access and the grammar itself."""

import random
import zlib

import numpy as np
import pytest

import corpora
from opsloom.llm import packing, repair


def expected(rows):
    """``doc_id, start, n_tokens, ids_crc32`` by the defining library, in ascending order of ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, repair.round_trip(docs.repartition(5)).collect())) == expected(rows)


def test_awkward_rows(spark):
    rows = corpora.rows()
    unique = {r[0]: r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1}
    docs = spark.createDataFrame(list(unique.values()), corpora.SCHEMA)
    out = sorted(map(tuple, repair.round_trip(docs).collect()))
    assert out == expected(sorted((i, r[1]) for i, r in unique.items()))
    everything = sorted(repair.round_trip(corpora.documents(spark)).collect(), key=lambda r: r.start)
    assert len(everything) == len(rows)
    ids = [r.doc_id for r in everything]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in everything] == list(np.cumsum([0] + [r.n_tokens for r in everything])[:-1])
    assert repair.round_trip(corpora.no_documents(spark)).collect() == []


def test_small_shards_and_random_access(spark, tmp_path):
    draw = random.Random(3)
    pool = [f"syllable{i} " for i in range(30)]
    rows = [(i * 3, "".join(draw.choices(pool, k=draw.randint(0, 400))), "en", "a") for i in range(120)]
    path = str(tmp_path / "files")
    repair.write_token_files(corpora.table(spark, *rows), path, shard_ids=2_000)
    assert spark.read.parquet(path).count() > 20
    assert sorted(map(tuple, repair.read_token_files(spark, path).collect())) == expected([r[:2] for r in rows])
    encoder = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    for doc_id, text, *_ in draw.sample(rows, 3):
        whole = [*encoder.ids(text), 2]
        at, n = len(whole) // 3, 17
        assert [r.ids for r in repair.token_ids(spark, path, doc_id).collect()] == [whole]
        assert [r.ids for r in repair.token_ids(spark, path, doc_id, at, n).collect()] == [whole[at : at + n]]
    assert repair.token_ids(spark, path, 1).collect() == []


@pytest.mark.parametrize("top", [3, 50_000, 5_000_000])
def test_grammar(top):
    draw = np.random.default_rng(top)
    sizes = draw.integers(0, 60, 200)
    ids = draw.integers(0, top, sizes.sum()).astype(np.uint32)
    at = np.flatnonzero(draw.random(len(ids) - 4) < 0.1)
    for k in range(4):
        ids[at + k] = 2 - k % 2  # a frequent stretch
    grammar = repair.compress(ids, sizes)
    assert len(grammar["symbols"]) + 2 * len(grammar["left"]) < len(ids) and len(grammar["left"])
    # rules use earlier symbols only, and none spans two documents
    own = len(grammar["terminals"]) + np.arange(len(grammar["left"]))
    assert (grammar["left"] < own).all() and (grammar["right"] < own).all()
    shard = repair.Shard(repair.to_bytes([*range(199), None], sizes, grammar))
    assert (shard.all_ids() == ids).all() and shard.doc_ids == [*range(199), None]
    for k in (0, 7, 199):
        begin = sizes[:k].sum()
        whole = ids[begin : begin + sizes[k]]
        assert (shard.ids(k) == whole).all()
        for first in range(0, len(whole), 5):
            assert (shard.ids(k, first, 7) == whole[first : first + 7]).all()


def test_runs_of_one_id():
    for n in (0, 1, 2, 3, 11, 1000):
        ids, sizes = np.full(n + 1, 9, np.uint32), np.array([n, 1])
        grammar = repair.compress(ids, sizes)
        shard = repair.Shard(repair.to_bytes([1, 2], sizes, grammar))
        assert (shard.all_ids() == ids).all()
        assert len(grammar["symbols"]) <= max(12, n // 8)


def test_foreign_bytes():
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 64)
