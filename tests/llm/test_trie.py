"""The prefix trie against a direct walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from opsloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, node string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "d", "o", "n") for r in rows], SCHEMA).repartition(parts)


def rebuilt(rows, families):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if not families:
        return own
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + ts[h(c) :] for c, ts in own.items()}


def brute(rows, families=True):
    convs = rebuilt(rows, families)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (own[0], len(node), -1 if not node else members[node[:-1]][0], len(own), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, own in members.items()
    )


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def random_rows(seed, convs=60, hot=0):
    draw = random.Random(seed)
    texts = ["", "a", "bb", "ccc", None, "Ünï"]
    rows = []
    for c in draw.sample(range(320), convs) + [100, 200]:
        for turn in range(draw.randint(1, 9)):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(texts)))
    for copy in (0, 7, 201, 305)[: 4 if hot else 0]:  # long conversations, mostly equal
        rows += [(copy + 400, t, "user", f"turn {t}") for t in range(hot)]
    rows += [(5, None, "user", "first"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "user", "other tie"), (None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("seed, families", [(0, True), (1, False)])
def test_random_conversations(spark, seed, families):
    rows = random_rows(seed)
    assert found(trie.trie_nodes(table(spark, rows), families)) == brute(rows, families)


@pytest.mark.parametrize("bits", [10, None])
def test_long_conversations_over_many_parts(spark, bits):
    rows = random_rows(9, hot=150)
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        assert found(trie.trie_nodes(table(spark, rows, 5), bits=bits)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parts_that_begin_anywhere():
    """Every cut of the sorted rows into three parts gives the prefixes of the whole."""
    import numpy as np
    import pyarrow as pa

    rows = []
    for conv, skip, lent, own in ((1, 3, 2, 5), (2, 5, 5, 3), (3, 0, 0, 2)):
        rows.append((conv, 0, None, 0, skip))
        for kind, n in ((1, lent), (2, own)):
            rows += [(conv, kind, hashlib.md5(f"{conv}{kind}{i}".encode()).digest(), 10 * kind + i, skip) for i in range(n)]
    names = ["conv_id", "kind", "digest", "points", "skip"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]

    def walked(cuts, size):
        out = []
        edges = [0, *cuts, len(rows)]
        for part, (a, b) in enumerate(zip(edges, edges[1:])):
            walk = trie._Walk(part)
            for at in range(a, b, size):
                columns = zip(*rows[at : min(at + size, b)])
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                out += [r for x in walk.take(batch) for r in x.to_pylist()]
            out += [r for x in walk.close() for r in x.to_pylist()]
        return out

    plain = {(r["conv_id"], r["depth"]): (r["a"], r["b"], r["upto"]) for r in walked([], 100) if r["kind"] != 3}
    last = {c: max(d for k, d in plain if k == c) for c in (1, 2, 3)}
    with np.errstate(over="ignore"):
        for i in range(len(rows) + 1):
            for j in range(i, len(rows) + 1):
                out = walked([i, j], 4)
                carries = trie._carries(
                    [r for r in out if r["kind"] == 3],
                    [r for r in out if r["open"] and r["kind"] != 3 and r["at"] < 12],
                )
                for part, c in carries.items():
                    for edge in ("last_depth", "open_depth"):
                        if edge in c:
                            convs = {r["conv_id"] for r in out if r["part"] == part and r["open"] == (edge == "open_depth")}
                            assert c[edge] in {last[x] for x in convs}
                    if "sum" in c:
                        conv = next(r["conv_id"] for r in out if r["part"] == part and r["open"])
                        a, b, upto = plain[conv, c["depth"]]
                        assert (c["sum"], c["upto"]) == ((a % 2**64, b % 2**64), upto)


def test_empty_table(spark):
    assert trie.trie_nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_and_clashing_columns(spark):
    rows = [(300, 1, "user", "x" * 100_000), (300, 2, None, None)]
    assert found(trie.trie_nodes(table(spark, rows))) == brute(rows)


def test_digest_of_many_members(spark):
    n = 40_000
    ends = spark.range(n).selectExpr("5L as a", "id % 2 as b", "id as conv_id").repartition(7)
    out = {r.b: r.ends_sha256 for r in trie._ends_digests(ends).collect()}
    for b in (0, 1):
        assert out[b] == hashlib.sha256(",".join(map(str, range(b, n, 2))).encode()).hexdigest()
