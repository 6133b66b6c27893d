"""A stored vector index that skips by the triangle inequality: exact top-k without reading every file.

Vectors are clustered by direction and stored a folder a list, with each
list's centroid and radius (the greatest angle to it) beside them.  A row of a
list is at least ``angle(probe, centroid) - radius`` away, so lists are read by
that bound, nearest first, until the next one cannot hold a winner.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from opsloom.functions.vectors import local_top_k
from opsloom.operators.retrieval import SCORE_DIGITS, with_rank

#: the fit sees about this many vectors; lists are at most this many
SAMPLE, MOST_LISTS = 16_384, 1024
#: rows that take no part in the clustering: zero vectors, and those of another width
ZERO, OTHER = -1, -2
_SEED = 7


def _unit(flat: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(size > 0, size, 1.0)


def _centroids(units: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Directions of clusters, by spherical k-means over the sample."""
    draw = np.random.default_rng(_SEED)
    centroids = units[np.sort(draw.choice(len(units), count, replace=False))]
    for _ in range(rounds):
        own = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centroids)
    return centroids


def write_index(rows: DataFrame, path: str, id_col: str, vector: str = "embedding", lists: int | None = None) -> None:
    """Store all rows by list, all columns kept, and one row a list with its centroid, radius and number of rows.

    The fit uses a hash sample of about ``SAMPLE`` vectors; every row is
    assigned and stored.  The most frequent width is indexed; rows of another
    width, and zero vectors, lie in lists of their own.  Null vectors and
    vectors with components that are no numbers are left out, as they have no
    similarity.
    """
    spark = rows.sparkSession
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))
    widths = good.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (widths["width"], widths["n"]) if widths else (0, 0)
    share = F.pmod(F.xxhash64(F.lit(_SEED), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = good.where((F.size(vector) == width) & (share * n < SAMPLE)).orderBy(share, id_col).limit(2 * SAMPLE)
    sample = _unit(np.array([list(r[0]) for r in chosen.select(vector).collect()], dtype="float64").reshape(-1, max(width, 1)))
    distinct = np.unique(sample[np.linalg.norm(sample, axis=1) > 0], axis=0)
    count = min(len(distinct), MOST_LISTS, lists or max(1, math.isqrt(n) // 2))
    centroids = _centroids(distinct, count) if count else np.zeros((0, max(width, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(vector))
            own, cosine = np.full(len(vectors), OTHER, np.int32), np.zeros(len(vectors))
            at = np.flatnonzero(np.asarray(vectors.value_lengths()) == width)
            if len(at):
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("float64")
                units = _unit(flat.reshape(-1, width))
                zero = ~units.any(axis=1)
                product = units @ centroids.T if len(centroids) else np.zeros((len(units), 1))
                own[at] = np.where(zero, ZERO, product.argmax(axis=1))
                cosine[at] = product.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(cosine)], [*batch.schema.names, "__list", "__cosine"])

    schema = T.StructType([*good.schema, T.StructField("__list", T.IntegerType()), T.StructField("__cosine", T.DoubleType())])
    good.mapInArrow(assign, schema).hint("rebalance", "__list").write.partitionBy("__list").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    shape = stored.groupBy("__list").agg(F.count("*").alias("n"), F.min("__cosine").alias("least")).collect()  # a row a list
    told = [
        (r["__list"], r["n"], float(math.acos(min(1.0, max(-1.0, r["least"])))), centroids[r["__list"]].tolist() if r["__list"] >= 0 else [], width)
        for r in shape
    ]
    lists_of = spark.createDataFrame(told, "list int, n long, radius double, centroid array<double>, width int")
    lists_of.coalesce(1).write.parquet(f"{path}/lists")
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/shape")


def top_k(
    spark: SparkSession, path: str, probe: Sequence[float], k: int, id_col: str, vector: str = "embedding", where: Column | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The ``k`` rows nearest to a probe: id, similarity, rank, as a scan gives them; and how many lists and rows were read.

    ``where`` filters rows before they are scored; it reaches the files.
    """
    lists = spark.read.parquet(f"{path}/lists").collect()  # at most MOST_LISTS + 2 rows
    counter = {"lists": 0, "of_lists": len(lists), "rows": 0, "of_rows": sum(r["n"] for r in lists)}
    unit = np.asarray(probe, dtype="float64")
    unit = unit / (np.linalg.norm(unit) or 1.0)
    bounds = []
    for r in lists:
        if (r["list"] == OTHER) != (len(unit) != r["width"]):
            continue  # another width has no similarity
        if r["list"] < 0 or not unit.any():
            bounds.append((1.0 if r["list"] == OTHER else 0.0, r["list"], r["n"]))
        else:
            angle = math.acos(min(1.0, max(-1.0, float(unit @ np.asarray(r["centroid"])))))
            # cosines and angles are rounded: a little slack keeps the bound true
            bounds.append((math.cos(max(0.0, angle - r["radius"] - 1e-7)), r["list"], r["n"]))
    bounds.sort(reverse=True)
    shape = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/shape").first()[0]))
    stored = spark.read.schema(shape).parquet(f"{path}/rows")
    stored = stored if where is None else stored.where(where)
    found: list[tuple] = []
    at, width = 0, 1
    while at < len(bounds):
        if len(found) == k and bounds[at][0] + 10.0**-SCORE_DIGITS < found[-1][1]:
            break
        turn = bounds[at : at + width]
        near = stored.where(F.col("__list").isin([b[1] for b in turn]))
        best = local_top_k(near, id_col, vector, [list(probe)], k, SCORE_DIGITS).orderBy(F.desc("similarity"), id_col).limit(k)
        found = sorted(found + [(r[id_col], r["similarity"]) for r in best.collect()], key=lambda f: (-f[1], f[0]))[:k]
        counter["lists"] += len(turn)
        counter["rows"] += sum(b[2] for b in turn)
        at, width = at + width, 2 * width
    id_type = dict(stored.dtypes)[id_col]
    hits = spark.createDataFrame(found, f"`{id_col}` {id_type}, similarity double")
    return with_rank(hits, "similarity", id_col), counter
