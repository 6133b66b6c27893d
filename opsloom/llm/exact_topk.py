"""Exact top-k by columnar branch-and-bound on whole-number vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.llm.vectors import taking_part, usable

K = 5
SCALE = 256
#: rows and queries that meet in one task group, and components of a column block
BLOCK, QUERIES, COLUMNS = 1024, 512, 16
#: sums of products up to here are exact in double precision
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """``vec_id, vector`` with ``floor(256 * x)`` of each component; width and number of rows."""
    rows, width, n, _ = usable(vectors, id_col, vector_col, zeros=True)
    return rows.select("vec_id", _whole().alias("vector")), width, n


def _whole() -> Column:
    return F.transform("vector", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))


def _norms_behind(columns: np.ndarray) -> np.ndarray:
    """Per block start, the norm of each vector's components from there on; slightly enlarged against rounding."""
    squares = np.square(columns.astype(np.float64))
    tails = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(tails) * (1.0 + 1e-9)


def bounded_top(query: np.ndarray, behind: np.ndarray, own: np.ndarray, columns: np.ndarray, columns_behind: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that can be among the ``k`` best of a query, with their exact scores.

    Products are added column block by column block.  What is still to come is
    at most the product of the remaining norms; a candidate that cannot reach
    the k-th score found so far is dropped and the survivors are compacted.
    """
    width, rows = columns.shape
    kept, scores = np.empty(0, np.int64), np.empty(0, columns.dtype)
    least = -np.inf
    for start in range(0, rows, 256):
        alive = start + np.flatnonzero(~own[start : start + 256])
        so_far = np.zeros(len(alive), columns.dtype)
        for low in range(0, width, COLUMNS):
            so_far = so_far + query[low : low + COLUMNS] @ columns[low : low + COLUMNS, alive]
            high = low + COLUMNS
            to_come = behind[high] * columns_behind[high, alive] if high < width else 0.0
            stay = so_far.astype(np.float64) + to_come >= least
            alive, so_far = alive[stay], so_far[stay]
            if not len(alive):
                break
        kept, scores = np.r_[kept, alive], np.r_[scores, so_far]
        if len(kept) >= k:
            reached = np.sort(scores)[-k]
            good = scores >= reached
            # a little lower, so that rounding of the bound never drops a tie
            kept, scores, least = kept[good], scores[good], float(reached) - abs(float(reached)) * 1e-9 - 1e-6
    return kept, scores


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each row of ``queries``.

    Exact: rows and queries are both cut into blocks by a hash of their id, and
    each block of queries meets each block of rows in one task group; only the
    ``k`` best of a meeting go on.  Ties go to the smaller id.

    Vectors that are null, empty or hold null or non-finite components, and
    rows without an id, take no part; zero vectors do; of several lengths the
    most frequent one of ``vectors`` does, among the queries too.  Components too large for a 64-bit number are cut
    to its ends before, and scores after, an exact sum.  The query's own id is
    left out; repeated rows are candidates each, a repeated query id is asked
    once (with its least vector).  An empty table gives no rows.
    """
    rows, width, n = quantised(vectors, id_col, vector_col)
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = taking_part(queries, id_col, vector_col, zeros=True).where(F.size("vector") == width)
    asked = asked.select("vec_id", _whole().alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks, turns = -(-n // BLOCK), max(1, -(-asked.count() // QUERIES))
    salt = F.xxhash64(F.lit(3), "vec_id")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = asked.withColumn("turn", F.pmod(salt, F.lit(turns)).cast("int")).withColumn("block", each(blocks))
    right = rows.withColumn("block", F.pmod(salt, F.lit(blocks)).cast("int")).withColumn("turn", each(turns))

    def met(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids = block["vec_id"].to_numpy()
        columns = np.stack(block["vector"].to_list()).T if len(block) else np.empty((width, 0), np.int64)
        wanted = np.stack(asking["vector"].to_list()) if len(asking) else np.empty((0, width), np.int64)
        largest = [float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in (columns, wanted)]
        exact = largest[0] * largest[1] * width < _EXACT
        # whole numbers in doubles are exact up to 2**53; beyond, Python's own
        kind = np.float64 if exact else object
        columns, wanted = np.ascontiguousarray(columns.astype(kind)), wanted.astype(kind)
        behind, wanted_behind = _norms_behind(columns), _norms_behind(wanted.T)
        out = []
        for at, (query_id, vector) in enumerate(zip(asking["vec_id"].to_numpy(), wanted)):
            near, scores = bounded_top(vector, wanted_behind[:, at], ids == query_id, columns, behind, k)
            order = sorted(range(len(near)), key=lambda i: (-scores[i], ids[near[i]]))[:k]
            out += [(query_id, ids[near[i]], min(max(int(scores[i]), _LEAST), _MOST)) for i in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    group = ["block", "turn"]
    pairs = left.select(*group, "vec_id", "vector").groupBy(*group).cogroup(right.select(*group, "vec_id", "vector").groupBy(*group))
    found = pairs.applyInPandas(met, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
