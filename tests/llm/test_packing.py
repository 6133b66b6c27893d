"""Packing against best fit piece by piece, and token ids against the library that defines them."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpora
from opsloom.llm import packing


def piecewise(lengths, capacity):
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        room = free.pop(at) if at < len(free) else capacity
        bins += room == capacity
        if room - n:
            bisect.insort(free, room - n)
    return bins


@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([64, 100, 1024]))
@settings(max_examples=150, deadline=None)
def test_best_fit_equals_piece_by_piece(lengths, capacity):
    histogram = Counter(lengths)
    runs, bins = packing.best_fit(histogram, capacity)
    assert bins == piecewise(lengths, capacity)
    content = defaultdict(list)
    for n, count in histogram.items():
        table = np.array(runs[n])
        for rank in range(count):
            start, first, offset, per = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
            content[first + (rank - start) // per].append((offset + (rank - start) % per * n, n))
    assert len(content) == bins
    for parts in content.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_capacity_tree():
    tree, draw, held = packing.CapacityTree(1024), random.Random(1), Counter()
    for _ in range(3000):
        room = draw.randint(1, 1024)
        if held[room] and draw.random() < 0.5:
            tree.add(room, -1)
            held[room] -= 1
        else:
            tree.add(room, 1)
            held[room] += 1
        length = draw.randint(1, 1024)
        assert tree.tightest(length) == min((r for r, n in held.items() if n and r >= length), default=None)


def test_cut_points():
    assert packing.cut_points(1) == [(0, 1)]
    assert packing.cut_points(1024) == [(0, 1024)]
    assert packing.cut_points(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))


def exact(encoder, text):
    return encoder.exact.encode(text, add_special_tokens=False).ids


@given(st.text(st.characters(max_codepoint=0x24F), max_size=200))
@settings(max_examples=400, deadline=None)
def test_fast_ids_are_the_defined_ids(encoder, text):
    assert encoder.ids(text) == exact(encoder, text)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(encoder, text):
    assert encoder.ids(text) == exact(encoder, text)


def test_every_fast_character_between_others(encoder):
    for code in [*range(1, 0x250), *range(0x2010, 0x2028), 0x20AC]:
        for text in (f"a{chr(code)}b", f" {chr(code)} 1{chr(code)}{chr(code)}", f"\n{chr(code)}'s"):
            assert encoder.ids(text) == exact(encoder, text), hex(code)


def test_documents_of_the_tables(encoder, spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert encoder.ids(row.text) == exact(encoder, row.text)
    assert encoder.ids("a <|endoftext|> b") == exact(encoder, "a <|endoftext|> b")


def check(out, rows, encoder, capacity=1024):
    """Every document's pieces cover its ids; every sequence is full from 0 without gaps."""
    ids = Counter()
    for doc_id, text in rows:
        own = [*exact(encoder, text or ""), 2]
        for piece, (start, n) in enumerate(packing.cut_points(len(own), capacity)):
            part = np.array(own[start : start + n], "<u4").tobytes()
            ids[doc_id, piece, start, n, zlib.crc32(part)] += 1
    assert ids == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(sequences) == piecewise([r.length for r in out], capacity)


def test_awkward_rows(spark, encoder):
    out = packing.pack_documents(corpora.documents(spark)).collect()
    check(out, [(r[0], r[1]) for r in corpora.rows()], encoder)


def test_large_ids_beside_nulls_and_a_hot_length(spark, encoder):
    big = (1 << 62) + 1
    rows = [(big, "one", "en", "s"), (None, "two", "en", "s")] + [(i, "same words", "en", "s") for i in range(500)]
    out = packing.pack_documents(corpora.table(spark, *rows).repartition(6), capacity=16).collect()
    check(out, [(i, t) for i, t, _, _ in rows], encoder, 16)


def test_ids_on_request_and_empty_table(spark, encoder):
    docs = corpora.table(spark, (1, "some words to cut", "en", "s"))
    pieces = packing.token_pieces(docs, capacity=2, with_ids=True).orderBy("piece").collect()
    assert [i for r in pieces for i in r.ids] == [*exact(encoder, "some words to cut"), 2]
    assert packing.pack_documents(corpora.no_documents(spark)).collect() == []
