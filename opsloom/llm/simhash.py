"""SimHash near-duplicates found through deletion variants of fingerprint segments."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from opsloom.llm.components import components
from opsloom.session import cut_lineage

BITS = 64
SHINGLE = 4
RADIUS = 4
#: near copies by word shingles: width, least Jaccard similarity, shingles kept for a first estimate (standard error 0.025)
NEAR_SHINGLE, NEAR_LEAST, SKETCH = 5, 0.8, 256
#: bits within which all pairs meet by a fingerprint, and those up to which pairs that meet are taken as candidates
NEAR_RADIUS, NEAR_LIMIT = 7, 12
#: least hashes of a set joined into one band, and bands: pairs at 0.8 share one with 1 - (1 - 0.8^5)^20 = 0.9996
BAND, BANDS = 5, 20
#: candidates a member of a bucket that are written as pairs; crowded buckets beyond are compared by sketches in their task
PAIRS = 4
#: members of a crowded bucket that meet in one task; of a larger one, blocks of so many meet in turns
BLOCK = 4_096
#: estimates from trimmed sketches that count as surely similar, and that may be (four standard errors)
SURE, MAYBE = 0.1, -0.1
SEED = 42
#: members of one index bucket that are compared pair by pair; larger buckets are linked through ball centres
BUCKET = 16_384

_FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; none for a text without words."""
    import xxhash

    # bytes.split() without arguments splits at exactly [\x20\x09-\x0D]
    parts = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    wide = min(words, len(parts))
    starts, ends = (ends - lengths)[: len(parts) - wide + 1].tolist(), ends[wide - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, what more than half of the hashes have set; 0 without hashes."""
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        octets = hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def rehashed(hashes: np.ndarray) -> np.ndarray:
    """Another hash of each shingle, made from the first: gives a second, independent fingerprint."""
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sketch(hashes: np.ndarray, size: int) -> bytes:
    """The ``size`` least distinct hashes (their upper halves), which stand for the set of shingles."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))[:size].tobytes()


def similarity(a: bytes, b: bytes, size: int) -> float:
    """Jaccard similarity of two shingle sets: exact below ``size`` shingles, else from the least of the union."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if max(len(x), len(y)) == size:
        union = union[:size]
    return len(np.intersect1d(np.intersect1d(x, y, True), union, True)) / len(union) if len(union) else 1.0


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands of a set: two sets share a band with the fifth power of their Jaccard similarity."""
    import xxhash

    factors, offsets = _multipliers()
    least, step = np.full(BAND * BANDS, np.iinfo(np.uint64).max, np.uint64), 1 << 12
    for at in range(0, len(hashes), step):
        mixed = rehashed(hashes[at : at + step, None] * factors + offsets)
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, BAND))]


def similarities(one: np.ndarray, many: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`similarity` of one sketch and rows of others (padded), and which of them are exact."""
    at = np.searchsorted(one, many)
    hit = (one[np.minimum(at, len(one) - 1)] == many) & (np.arange(many.shape[1]) < lengths[:, None])
    # place in the union: members before it in either, common ones once
    place = np.arange(many.shape[1]) + at - (np.cumsum(hit, axis=1) - hit)
    exact = (lengths < size) & (len(one) < size)
    union = lengths + len(one) - hit.sum(axis=1)
    union = np.where(exact, union, np.minimum(union, size))
    return (hit & (exact[:, None] | (place < size))).sum(axis=1) / union, exact


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``fp``, the fingerprint of every whole text as a signed number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(text, words)) for text in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _signed(prints)], [*keep, "fp"])

    schema = docs.select(*keep).schema.add("fp", "long")
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(hashed, schema)


def shingle_sets(docs: DataFrame, words: int, keep: tuple[str, ...], size: int) -> DataFrame:
    """The ``keep`` columns with what stands for the set of distinct shingles of every whole text.

    ``node`` is a hash of the set: texts of one node have the same shingles, at
    any number of repeats.  ``fp`` and ``fp2`` are two independent fingerprints
    of the set, where a shingle counts once, so that repeated filler does not
    outweigh the rest.  ``shingles`` is the size of the set.
    """
    names = ["node", "fp", "fp2", "shingles", "sketch", "bands"]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = (np.unique(shingle_hashes(text, words)) for text in batch.columns[-1].to_pylist())
            rows = [
                (xxhash.xxh64_intdigest(s.tobytes(), SEED), fingerprint(s), fingerprint(rehashed(s)), len(s), sketch(s, size), np.array(bands(s), np.uint64).view(np.int64))
                for s in sets
            ]
            node, fp, fp2, shingles, sketches, keys = zip(*rows) if rows else [[]] * 6
            more = [_signed(node), _signed(fp), _signed(fp2), pa.array(shingles, pa.int64()), pa.array(sketches, pa.binary())]
            more.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*keep, *names])

    schema = docs.select(*keep).schema
    for name, kind in zip(names, ["long"] * 4 + ["binary", ArrayType(LongType())]):
        schema = schema.add(name, kind)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(described, schema)


def segments(radius: int) -> list[tuple[int, int]]:
    """First bit and width of the segments: so few that one of them differs by at most one bit."""
    count = radius // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def variant_keys(fp: Column, radius: int = RADIUS) -> Column:
    """All one-wildcard variants of all segments, as numbers.

    A variant leaves one bit of one segment open: two segments share a variant
    exactly if they differ in that bit at most.  The wildcard's place is part
    of the key, as the 64 variants of a fingerprint are numbered by it.
    """
    keys = []
    for low, width in segments(radius):
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(fp, low).bitwiseAND(mask)
        keys += [part.bitwiseAND(mask & ~(1 << bit)) * BITS + (low + bit) for bit in range(width)]
    return F.array(*keys)


def _forest(keys: np.ndarray, fps: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Edges that connect what the close pairs of each run of equal keys connect, without a cycle.

    Rows are sorted by key.  All pairs of a run are compared, at growing
    distances in the run; a pair inside one tree already adds nothing.  With
    several growing ``limits``, closer pairs become edges first.
    """
    n = len(keys)
    parent, tree = np.arange(n), np.arange(n)
    found: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for limit in limits:
        at = np.arange(n)
        for lag in range(1, n):
            at = at[at < n - lag]
            at = at[keys[at] == keys[at + lag]]
            if not len(at):
                break
            close = np.bitwise_count(fps[at] ^ fps[at + lag]) <= limit
            near = at[close & (tree[at] != tree[at + lag])]
            before = len(found)
            for i, j in zip(near.tolist(), (near + lag).tolist()):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((i, j))
            if len(found) > before:
                parent = _roots(parent)
                tree = parent.copy()
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _linked_runs(limits: tuple[int, ...], bucket: int):
    """Task body: sorted ``(key, fp, node)`` rows in, edges ``(a, b)`` of nodes out.

    Members of oversized runs come out as ``(fp, node)``, marked large.
    """

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 3), np.int64)

        def solve(rows: np.ndarray) -> pd.DataFrame:
            keys = rows[:, 0]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            size_of = np.repeat(sizes, sizes)
            large = rows[size_of > bucket]
            some = rows[(size_of > 1) & (size_of <= bucket)]
            pairs = _forest(some[:, 0], np.ascontiguousarray(some[:, 1]).view(np.uint64), limits)
            nodes = some[:, 2]
            a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
            return pd.DataFrame(
                {
                    "a": np.r_[np.minimum(a, b), large[:, 1]],
                    "b": np.r_[np.maximum(a, b), large[:, 2]],
                    "large": np.r_[np.zeros(len(a), bool), np.ones(len(large), bool)],
                }
            )

        for batch in batches:
            rows = np.concatenate([held, batch[["key", "fp", "node"]].to_numpy(np.int64)])
            last = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0
            if last:
                yield solve(rows[:last])
            held = rows[last:]
        yield solve(held)

    return linked


def _centres(radius: int) -> Column:
    """Bit masks of all centres within half the radius."""
    near = [0]
    for _ in range(radius // 2):
        near = sorted({m ^ (1 << bit) for m in near for bit in range(BITS)} | set(near))
    return F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in near])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, limits: tuple[int, ...] = (RADIUS,), bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between the nodes of ``distinct`` (``fp, node``) that connect those at most ``limits[-1]`` bits apart.

    All pairs up to ``radius`` bits meet, and many beyond: by an equality
    shuffle on their variants.  Each bucket is verified and only a spanning
    forest of its links is returned, never all pairs.  Members of a bucket
    above ``bucket`` are linked another way, exact up to four bits: two
    fingerprints are at most four bits apart if and only if some centre is at
    most two from both, so all members that share a centre are linked to the
    least of them.  That costs a fixed number of rows for each member, however
    large the bucket.
    """
    rows = distinct.select(F.explode(variant_keys(F.col("fp"), radius)).alias("key"), "fp", "node")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "fp", "node")
    met = cut_lineage(sorted_rows.mapInPandas(_linked_runs(limits, bucket), "a long, b long, large boolean"), "simhash-links")
    crowded = met.where("large").select(F.col("a").alias("fp"), F.col("b").alias("node")).distinct()
    centred = crowded.select(F.explode(_centres(RADIUS)).alias("mask"), "fp", "node")
    centred = centred.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"), "node")
    least = centred.groupBy("centre").agg(F.min("node").alias("a"))
    through = centred.join(least, "centre").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    return met.where(~F.col("large") & (F.col("a") != F.col("b"))).select("a", "b").unionByName(through).distinct()


def fingerprint_groups(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, component`` for every fingerprint of a written table: ``component`` is its least fingerprint."""
    named = distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
    return cut_lineage(named.select("fp", F.coalesce("label", "fp").alias("component")), "fingerprint-groups")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Equal fingerprints are one node; the component is named by the smallest
    ``doc_id`` that can be reached over links of at most four bits.
    Null, empty and blank texts have fingerprint 0 and link like any other;
    shorter texts than a shingle are one shingle.  A null ``doc_id`` takes part
    but names no component (null, if all are null).  Repeated rows stay.
    """
    hashed = cut_lineage(fingerprints(docs, words), "fingerprints")
    firsts = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = fingerprint_links(firsts.select("fp", F.col("fp").alias("node")), bucket=bucket)
    groups = fingerprint_groups(firsts.select("fp"), links)
    labelled = cut_lineage(groups.join(firsts, "fp"), "labelled")
    named = cut_lineage(labelled.groupBy("component").agg(F.min("first_id").alias("component_id")), "named")
    of_fp = cut_lineage(labelled.join(named, "component").select("fp", "component_id"), "components")
    return hashed.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _close_pairs(keys: np.ndarray, fps: np.ndarray, limit: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs at most ``limit`` bits apart of each run of equal keys, and the rows of crowded runs instead of theirs."""
    n = len(keys)
    run = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.bincount(run)
    open_, count = sizes <= bucket, np.zeros(len(sizes), np.int64)
    found, at = [np.empty(0, np.int64)], np.arange(n)
    others, lag = [np.empty(0, np.int64)], 1
    while True:
        at = at[at < n - lag]
        at = at[(run[at] == run[at + lag]) & open_[run[at]]]
        if not len(at):
            break
        close = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= limit]
        count += np.bincount(run[close], minlength=len(count))
        open_ &= count <= PAIRS * sizes
        found.append(close)
        others.append(close + lag)
        lag += 1
    i, j = np.concatenate(found), np.concatenate(others)
    calm = open_[run[i]]
    return i[calm], j[calm], np.flatnonzero(~open_[run])


def _met_in_runs(limit: int, bucket: int):
    """Task body: sorted ``(key, fp, node)`` rows in; pairs ``a, b`` out, and ``key, a`` of the members of crowded runs."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 3), np.int64)

        def solve(rows: np.ndarray) -> pd.DataFrame:
            i, j, crowd = _close_pairs(rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64), limit, bucket)
            a, b = rows[i, 2], rows[j, 2]
            return pd.DataFrame(
                {
                    "key": np.r_[rows[i, 0], rows[crowd, 0]],
                    "a": np.r_[np.minimum(a, b), rows[crowd, 2]],
                    "b": np.r_[np.maximum(a, b), rows[crowd, 2]],
                    "crowded": np.r_[np.zeros(len(i), bool), np.ones(len(crowd), bool)],
                }
            )

        for batch in batches:
            rows = np.concatenate([held, batch[["key", "fp", "node"]].to_numpy(np.int64)])
            last = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0
            if last:
                yield solve(rows[:last])
            held = rows[last:]
        yield solve(held)

    return met


def _crowd_pairs(sketches: list[bytes], labels: np.ndarray | None, least: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one crowded bucket to be verified.

    Without labels, a spanning forest of the pairs that look similar.  With the
    labels of what was verified so far, all further pairs that may be similar,
    but for those inside a tree of equal labels and surely similar pairs.
    """
    parts = [np.frombuffer(s, "<u4") for s in sketches]
    lengths = np.array([len(p) for p in parts])
    padded = np.full((len(parts), lengths.max()), np.iinfo(np.uint32).max, np.uint32)
    for row, part in zip(padded, parts):
        row[: len(part)] = part
    tree = np.arange(len(parts)) if labels is None else np.unique(labels, return_inverse=True)[1]
    pairs = []
    for h, part in enumerate(parts):
        others = np.flatnonzero(tree[h + 1 :] != tree[h]) + h + 1
        if not len(others):
            if (tree == tree[h]).all():
                break
            continue
        value, exact = similarities(part, padded[others], lengths[others], size)
        if labels is None:
            joins = value >= least
            _, once = np.unique(tree[others[joins]], return_index=True)
            asked = others[joins][once]
        else:
            joins = value >= np.where(exact, least, least + SURE)
            _, once = np.unique(tree[others[joins]], return_index=True)
            asked = np.r_[others[joins][once], others[~joins & ~exact & (value >= least + MAYBE)]]
        pairs.append((np.full(len(asked), h), asked))
        tree[np.isin(tree, tree[others[joins]])] = tree[h]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _met_in_crowds(labelled: bool, least: float, size: int):
    """Task body: rows of crowded buckets, sorted by ``key, low, high``, in; pairs ``a, b`` out."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            i, j = _crowd_pairs(rows["sketch"].tolist(), rows["label"].to_numpy() if labelled else None, least, size)
            a, b = rows["node"].to_numpy()[i], rows["node"].to_numpy()[j]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            group = rows[["key", "low", "high"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(group) else np.array([0])
            for start, end in zip(starts, starts[1:]):
                yield solve(rows.iloc[start:end])
            held = rows.iloc[starts[-1] :]
        if held is not None and len(held):
            yield solve(held)

    return met


def crowd_links(crowded: DataFrame, nodes: DataFrame, labels: DataFrame | None, least: float, size: int, block: int = BLOCK) -> DataFrame:
    """Pairs ``a, b`` to be verified of the buckets in ``crowded`` (``key, node``).

    In a bucket of more than ``block`` members every two blocks meet, so that
    no task holds more than two blocks and all pairs are compared.
    """
    many = crowded.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")).where(F.col("blocks") > 1)
    placed = crowded.join(F.broadcast(many), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node")
    known = nodes.select("node", "sketch")
    if labels is not None:
        known = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = placed.join(known, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return rows.mapInPandas(_met_in_crowds(labels is not None, least, size), "a long, b long").distinct()


def exact_sets(need: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``node, hashes``: all distinct shingles of the text that stands for each node of ``need`` (``node, __r1, __r2``)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.columns[0], batch.columns[1].to_pylist()):
                hashes = np.unique(shingle_hashes(text, words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([hashes], pa.list_(pa.int64()))], ["node", "hashes"])

    texts = rows.join(need, ["__r1", "__r2"]).select("node", "text")
    schema = need.select("node").schema.add("hashes", ArrayType(LongType()))
    return cut_lineage(texts.mapInArrow(whole, schema).dropDuplicates(["node"]), "exact-sets")


def similar_links(links: DataFrame, nodes: DataFrame, rows: DataFrame, least: float, size: int, words: int) -> DataFrame:
    """The links whose two shingle sets have a Jaccard similarity of ``least`` or more, exactly.

    Sketches decide where they are whole sets, or where the estimate is at
    least four standard errors from ``least``; else the whole sets are compared.
    """
    of_a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("of_a"), F.col("shingles").alias("n_a"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("of_b"), F.col("shingles").alias("n_b"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = np.array([similarity(x, y, size) for x, y in zip(batch["of_a"], batch["of_b"])], float)
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            whole = np.maximum(n_a, n_b) < size
            possible = np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) * (1 - 1e-9)
            sure = np.where(whole, value >= least, value >= least + SURE)
            maybe = possible & ~whole & ~sure & (value >= least + MAYBE)
            yield batch[["a", "b"]].assign(sure=sure & possible)[(sure & possible) | maybe]

    verdicts = links.join(of_a, "a").join(of_b, "b").mapInPandas(judged, "a long, b long, sure boolean")
    verdicts = cut_lineage(verdicts, "near-judged")
    open_ = verdicts.where("not sure").select("a", "b")
    ends = open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct()
    sets = exact_sets(ends.join(nodes, "node").select("node", "first.__r1", "first.__r2"), rows, words)
    both = open_.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    close = counted.where(F.col("common") / (F.col("total") - F.col("common")) >= least)
    return verdicts.where("sure").select("a", "b").unionByName(close.select("a", "b"))


def near_links(nodes: DataFrame, docs: DataFrame, words: int, least: float, size: int, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Links between nodes that connect those with a Jaccard similarity of ``least`` or more.

    Pairs meet by two fingerprints and by bands.  A bucket with few candidates
    gives all of them.  In a crowded one a forest of what looks similar is
    verified first; then all pairs it has left apart are compared, so that a
    rejected link hides none.  ``docs`` holds the texts of ``first`` by their
    hashes ``__r1, __r2``.
    """
    worded = nodes.where(F.col("shingles") > 0)
    kinds = [(variant_keys(F.col("fp"), NEAR_RADIUS), "fp"), (F.transform(variant_keys(F.col("fp2"), NEAR_RADIUS), lambda k: k + (1 << 40)), "fp2")]
    rows = worded.select(F.explode("bands").alias("key"), F.lit(0).cast("long").alias("fp"), "node")
    for keys, name in kinds:
        rows = rows.unionByName(worded.select(F.explode(keys).alias("key"), F.col(name).alias("fp"), "node"))
    rows = rows.repartition("key").sortWithinPartitions("key", "fp", "node")
    met = rows.mapInPandas(_met_in_runs(NEAR_LIMIT, bucket), "key long, a long, b long, crowded boolean")
    met = cut_lineage(met, "near-met")
    crowded = met.where("crowded").select("key", F.col("a").alias("node"))
    asked = met.where("not crowded").select("a", "b").unionByName(crowd_links(crowded, nodes, None, least, size, block))
    asked = cut_lineage(asked.distinct(), "near-asked")
    links = cut_lineage(similar_links(asked, nodes, docs, least, size, words), "near-links")
    more = crowd_links(crowded, nodes, components(links), least, size, block).join(asked, ["a", "b"], "left_anti")
    return links.unionByName(cut_lineage(similar_links(more, nodes, docs, least, size, words), "near-links"))


def one_of_each(docs: DataFrame, words: int = NEAR_SHINGLE, least: float = NEAR_LEAST) -> DataFrame:
    """The documents without near copies, columns unchanged: of each group one row stays.

    Groups are connected by equal sets of word shingles and by pairs of sets
    with a Jaccard similarity of ``least`` or more.  Two independent
    fingerprints find the pairs, each by four segments, so that all pairs up to
    seven bits apart in one of them meet, and bands of least hashes find those
    that fingerprints leave apart.  :func:`near_links` verifies them.

    The row that stays is one with the smallest ``doc_id`` (a null one comes
    last); of several with that id the one with the smallest text hash, then
    row hash.  Only ids and hashes of the rows that stay meet the texts, in one
    join.  Texts without words are one group.
    """
    rows = docs.withColumns({"__r1": F.xxhash64("doc_id", "text"), "__r2": F.xxhash64(F.lit(1), "doc_id", "text")})
    hashed = cut_lineage(shingle_sets(rows, words, ("doc_id", "__r1", "__r2"), SKETCH), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__r1", "__r2")).alias("first")
    same = [F.min(name).alias(name) for name in ("fp", "fp2", "shingles", "sketch", "bands")]
    nodes = cut_lineage(hashed.groupBy("node").agg(first, *same), "shingle-nodes")
    links = near_links(nodes, rows, words, least, SKETCH)
    groups = fingerprint_groups(nodes.select(F.col("node").alias("fp")), links)
    chosen = groups.join(nodes.select(F.col("node").alias("fp"), "first"), "fp").groupBy("component").agg(F.min("first").alias("first"))
    stays = chosen.select("first.__r1", "first.__r2").hint("shuffle_hash")
    hashable = [name for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    repeated = Window.partitionBy("__r1", "__r2").orderBy(F.xxhash64(*hashable))
    kept = rows.join(stays, ["__r1", "__r2"], "left_semi").withColumn("__copy", F.row_number().over(repeated))
    return kept.where(F.col("__copy") == 1).select(*docs.columns)
