"""Vector columns as the search operators take them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """True for a vector with components, all of them numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, zeros: bool) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows with an id and a finite vector of any length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    return good if zeros else good.where(F.exists("vector", lambda x: x != 0.0))


def usable(vectors: DataFrame, id_col: str, vector_col: str, zeros: bool) -> tuple[DataFrame, int, int, float]:
    """``vec_id, vector`` (doubles) of the rows that take part; their width, number and largest component.

    Where lengths differ, the most frequent one takes part (the larger, if two
    are equally frequent).
    """
    good = taking_part(vectors, id_col, vector_col, zeros)
    largest = F.array_max(F.transform("vector", F.abs))
    found = good.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.max(largest).alias("largest"))
    best = found.orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return good, 0, 0, 0.0
    return good.where(F.size("vector") == best["width"]), best["width"], best["n"], best["largest"]


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """A column of vectors as one matrix."""
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.empty((0, width))


def ordered_product(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of a query with vectors given as columns, added in the order of the components.

    Equal vectors get equal sums wherever they lie, which a blocked matrix
    product does not promise.
    """
    total = np.zeros(columns.shape[1], columns.dtype)
    for x, column in zip(query, columns):
        total += x * column
    return total
