"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Largest inner product becomes least distance by one more component that gives
all vectors the same norm.  A random rotation then spreads the distance evenly
over the components, so the distance over the first few estimates the whole;
candidates whose estimate is significantly too large are abandoned early.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.vectors import matrix, ordered_product, taking_part, usable
from opsloom.session import cut_lineage

K = 20
#: vectors the lists are fitted to, at most about; those among them that give a query its first threshold
SAMPLE, PILOTS = 16_384, 8192
MOST_LISTS = 1024
#: share of the true neighbours, within the sample, that the probed lists must hold; queries this is measured with
RECALL, TRIALS = 0.95, 256
#: rows of neighbouring lists, and queries, that meet in one task group
BLOCK, QUERIES = 8192, 1024
#: components of a column block; significance of the abandoning test
COLUMNS, SIGNIFICANCE = 16, 2.1
#: queries whose first column block is compared at once
TILE = 64
#: rounding of a squared distance, as a share of the squared norm
_ROUNDING = 1e-10
_SEED = 11


@dataclass
class Lists:
    """A fitted index: rotation, centroids, the scale that gives all vectors one norm, and some placed rows."""

    scale: float
    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sizes: np.ndarray
    pilot_ids: np.ndarray
    pilots: np.ndarray

    def place(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Scaled vectors with the norm-levelling component (0 for queries), rotated."""
        scaled = vectors / self.scale
        missing = np.zeros(len(scaled)) if query else np.sqrt(np.maximum(self.norm - (scaled**2).sum(axis=1), 0.0))
        return np.column_stack([scaled, missing]) @ self.rotation

    def nearest(self, placed: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each row."""
        distance = (self.centroids**2).sum(axis=1) - 2.0 * placed @ self.centroids.T
        return np.argsort(distance, axis=1, kind="stable")[:, :count]

    def probed(self, placed: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, float]]:
        """For each query, the lists to scan and a first distance threshold.

        There are always lists enough to hold ``k`` candidates many times over.
        The threshold is a distance within which the pilots of these lists
        alone count twice ``k``: it can be too large, never too small.
        """
        near = self.nearest(placed, len(self.centroids))
        enough = (np.cumsum(self.sizes[near], axis=1) < 4 * k).sum(axis=1) + 1
        counts = np.maximum(enough, self.probes)
        homes = self.nearest(self.pilots, 1)[:, 0]
        for start in range(0, len(placed), TILE):
            tile = slice(start, start + TILE)
            for own, lists, distance in zip(ids[tile], [n[:c] for n, c in zip(near[tile], counts[tile])], squared_distances(placed[tile], self.pilots.T)):
                inside = np.zeros(len(self.centroids), bool)
                inside[lists] = True
                part = distance[inside[homes] & (self.pilot_ids != own)]
                yield lists, np.partition(part, 2 * k - 1)[2 * k - 1] if len(part) >= 2 * k else np.inf


def squared_distances(queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of queries (rows) to vectors in vertical layout (columns), over the components given."""
    own = np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->j", columns, columns)
    return own - 2.0 * queries @ columns


def _cluster(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids; an empty cluster takes the row farthest from its own."""
    draw = np.random.default_rng(_SEED)
    centroids = rows[np.sort(draw.choice(len(rows), count, replace=False))]
    for _ in range(rounds):
        distance = (centroids**2).sum(axis=1) - 2.0 * rows @ centroids.T
        own = distance.argmin(axis=1)
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        far = np.argsort(-distance[np.arange(len(rows)), own], kind="stable")
        centroids = sums / np.maximum(sizes, 1)[:, None]
        for at, empty in enumerate(np.flatnonzero(sizes == 0)):
            centroids[empty] = rows[far[at]]
    return centroids


def _probes(lists: Lists, vectors: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold ``recall`` of the true neighbours of some sampled vectors."""
    trials = vectors[:: max(1, len(vectors) // TRIALS)][:TRIALS]
    near = lists.nearest(lists.place(trials, query=True), len(lists.centroids))
    turn = np.argsort(near, axis=1)
    own = lists.nearest(lists.place(vectors), 1)[:, 0]
    product = trials @ vectors.T
    best = np.argsort(-product, axis=1, kind="stable")[:, 1 : k + 1]
    turns = np.sort(np.take_along_axis(turn, own[best], axis=1).ravel())
    return int(turns[math.ceil(recall * len(turns)) - 1]) + 1 if len(turns) else 1


def fit(rows: DataFrame, width: int, n: int, largest: float, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> Lists:
    """Fit an index to a hash sample of about ``sample`` vectors (all, if there are fewer).

    The number of lists grows with the square root of the rows; how many of
    them a query probes is measured on the sample, so poorly clustered vectors
    get more probes, not less recall.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.lit(largest)) * (x / F.lit(largest)))
    norm = rows.agg(F.max(squares)).first()[0]
    draw = F.xxhash64(F.lit(_SEED), "vec_id")
    share = F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the limit binds only if one id is repeated very often
    chosen = rows.where(share * n < sample).orderBy(draw, "vec_id", "vector").limit(2 * sample).toPandas()
    ids, vectors = chosen["vec_id"].to_numpy(), matrix(chosen["vector"], width)
    rotation, _ = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width + 1, width + 1)))
    none = np.empty((0, width + 1))
    lists = Lists(largest, float(norm), rotation, none, 1, np.zeros(0), ids[:PILOTS], none)
    placed = lists.place(vectors) if len(vectors) else np.zeros((1, width + 1))
    distinct = np.unique(placed, axis=0)
    lists.centroids = _cluster(distinct, min(len(distinct), MOST_LISTS, max(1, math.isqrt(n) // 4)))
    lists.sizes = np.bincount(lists.nearest(placed, 1)[:, 0], minlength=len(lists.centroids))
    lists.pilots = placed[: len(lists.pilot_ids)]
    lists.probes = _probes(lists, vectors, k, recall)
    return lists


def _threshold(limit: float, seen: int, width: int, rounding: float) -> float:
    """The largest distance over ``seen`` components that does not yet refute a full distance within ``limit``."""
    if seen >= width:
        return limit + rounding
    return limit * (1.0 + SIGNIFICANCE / math.sqrt(seen)) ** 2 * seen / width + rounding


def scan(
    query: np.ndarray, so_far: np.ndarray, candidates: np.ndarray, columns: np.ndarray, k: int, limit: float, rounding: float
) -> np.ndarray:
    """Those of ``candidates`` (column numbers) that may be among the ``k`` nearest of a placed query.

    ``columns`` holds the rows in vertical layout; ``so_far`` the distances of
    all of them over the first column block.  After each block, a candidate is
    abandoned if its distance, scaled up to all components, exceeds ``limit``
    beyond chance, and the survivors are compacted.
    """
    width, seen = len(columns), min(COLUMNS, len(columns))
    distance = so_far[candidates]
    while True:
        stay = distance <= _threshold(limit, seen, width, rounding)
        candidates, distance = candidates[stay], distance[stay]
        if seen >= width or not len(candidates):
            break
        block = slice(seen, seen + COLUMNS)
        part = columns[block][:, candidates] - query[block, None]
        distance = distance + np.einsum("ij,ij->j", part, part)
        seen = min(seen + COLUMNS, width)
    if len(candidates) > k:
        candidates = candidates[distance <= np.partition(distance, k - 1)[k - 1] + rounding]
    return candidates


def _grouped(sizes: dict[int, int]) -> tuple[dict[int, int], list[int]]:
    """The group of each list, and the number of blocks of each group: small lists together, large ones alone."""
    group_of, blocks, held = {}, [], BLOCK
    for one in sorted(sizes):
        if held + sizes[one] > BLOCK:
            blocks.append(max(1, -(-sizes[one] // BLOCK)))
            held = 0
        group_of[one] = len(blocks) - 1
        held = BLOCK if sizes[one] > BLOCK else held + sizes[one]
    return group_of, blocks


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each row of ``queries``.

    ``queries`` has the columns of ``vectors``.  Every vector is indexed; only
    the fit uses a sample.  Small lists share a block of about ``BLOCK`` rows
    and large ones are cut into several; the queries of a block are cut into
    turns of about ``QUERIES``, so neither a crowded list nor a popular one
    burdens one task.  Within a block, a query scans the rows of its lists
    under one threshold and passes on its ``k`` best.  Scores are inner
    products of the original vectors in double precision; ties go to the
    smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; of several lengths the most frequent
    one of ``vectors`` does, among the queries too.  A candidate with the query's id is its own row and left out;
    repeated rows are candidates each, a repeated query id is asked once (with
    its least vector).  An empty table gives no rows.
    """
    schema = "query_id long, vec_id long, score double"
    rows, width, n, largest = usable(vectors, id_col, vector_col, zeros=False)
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # plain arrays: the class itself travels with the functions that use it
    fitted = spark.sparkContext.broadcast(vars(fit(rows, width, n, largest, k, recall)))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = Lists(**fitted.value)
        for batch in batches:
            placed = lists.place(matrix(batch["vector"], width))
            yield batch.assign(list=lists.nearest(placed, 1)[:, 0].astype("int32") if len(batch) else [])

    index = cut_lineage(rows.mapInPandas(assigned, "vec_id long, vector array<double>, list int"), "ann-index")
    # at most MOST_LISTS rows
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    group_of, blocks = _grouped(sizes)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = Lists(**fitted.value)
        for batch in batches:
            placed = lists.place(matrix(batch["vector"], width), query=True)
            out = []
            turns = lists.probed(placed, batch["vec_id"].to_numpy(), k)
            for vec_id, vector, (near, limit) in zip(batch["vec_id"], batch["vector"], turns):
                own: dict[int, list[int]] = {}
                for one in near.tolist():
                    if one in group_of:
                        own.setdefault(group_of[one], []).append(one)
                out += [(vec_id, vector, limit, group, members) for group, members in own.items()]
            yield pd.DataFrame(out, columns=["vec_id", "vector", "limit", "group", "lists"])

    asked = taking_part(queries, id_col, vector_col, zeros=False)
    asked = asked.where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    probing = asked.mapInPandas(probed, "vec_id long, vector array<double>, limit double, group int, lists array<int>")
    probing = cut_lineage(probing, "ann-probes")

    turns = probing.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    homes = spark.createDataFrame([(one, group, blocks[group]) for one, group in group_of.items()], "list int, group int, blocks int")
    # at most MOST_LISTS rows
    shape = F.broadcast(homes.join(turns, "group"))
    salt = F.xxhash64(F.lit(_SEED), "vec_id")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = probing.join(F.broadcast(shape.select("group", "blocks", "turns").distinct()), "group")
    left = left.withColumn("turn", F.pmod(salt, "turns")).withColumn("block", each("blocks"))
    right = index.join(shape, "list").withColumn("block", F.pmod(salt, "blocks")).withColumn("turn", each("turns"))
    group = ["group", "block", "turn"]

    def scanned(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        lists = Lists(**fitted.value)
        ids, raw, member = block["vec_id"].to_numpy(), matrix(block["vector"], width), block["list"].to_numpy()
        columns, raw_columns = np.ascontiguousarray(lists.place(raw).T), np.ascontiguousarray(raw.T)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        vectors_of = matrix(asking["vector"], width)
        places = lists.place(vectors_of, query=True)
        query_ids, limits, own_lists = asking["vec_id"].to_numpy(), asking["limit"].to_numpy(), asking["lists"].to_list()
        wanted = np.zeros(len(lists.centroids), bool)
        for start in range(0, len(places), TILE):
            first = squared_distances(places[start : start + TILE, :COLUMNS], columns[:COLUMNS])
            for at, so_far in enumerate(first, start):
                wanted[:] = False
                wanted[own_lists[at]] = True
                candidates = np.flatnonzero(wanted[member] & (ids != query_ids[at]))
                rounding = _ROUNDING * (lists.norm + float(places[at] @ places[at]))
                near = scan(places[at], so_far, candidates, columns, k, limits[at], rounding)
                score = ordered_product(vectors_of[at], raw_columns[:, near])
                order = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(order), query_ids[at]), ids[near][order], score[order]))
        query_ids, vec_ids, scores = map(np.concatenate, zip(*found))
        return pd.DataFrame({"query_id": query_ids, "vec_id": vec_ids, "score": scores})

    asking = left.select(*group, "vec_id", "vector", "limit", "lists").groupBy(*group)
    met = asking.cogroup(right.select(*group, "vec_id", "vector", "list").groupBy(*group)).applyInPandas(scanned, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
