"""Shards cut from a Hilbert curve through quantised metadata (DataFrame operations only).

Rows near each other on the curve are near in every dimension, so a shard
spans a small range of each and a reader can skip files on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.llm.shared import global_rank
from opsloom.session import cut_lineage

BITS = 5
SHARDS = 24


def _turns(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: per state and corner, the corner's place and the next state.

    A state is the entry corner and the direction of travel in a cell; corners
    are visited in Gray-code order, turned to that entry and direction.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def left(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & mask

    def gray(x: int) -> int:
        return x ^ x >> 1

    place_of = {gray(w): w for w in range(size)}
    states, place, after = {(0, 0): 0}, [], []
    for entry, towards in iter_states(states):
        for corner in range(size):
            w = place_of[left(corner ^ entry, dims - (towards + 1) % dims)]
            inner_entry = gray((w - 1) // 2 * 2) if w else 0
            odd = w if w % 2 else w - 1
            inner_towards = (~odd & odd + 1).bit_length() - 1 if w else 0
            turned = (entry ^ left(inner_entry, towards + 1), (towards + inner_towards % dims + 1) % dims)
            place.append(w)
            after.append(states.setdefault(turned, len(states)))
    return place, after


def iter_states(states: dict):
    """The keys of a dictionary that grows while it is read."""
    done = 0
    while done < len(states):
        yield list(states)[done]
        done += 1


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell given by ``bits``-bit coordinates (two to four of them)."""
    dims = len(cells)
    place, after = (F.lit(table) for table in _turns(dims))

    def step(acc: Column, level: Column) -> Column:
        corner = sum(
            (F.shiftleft(F.call_function("shiftright", c, level).bitwiseAND(1), j) for j, c in enumerate(cells)), F.lit(0)
        )
        at = acc["state"] * (1 << dims) + corner
        return F.struct(
            (acc["index"] * (1 << dims) + F.get(place, at)).cast("long").alias("index"),
            F.get(after, at).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


#: distinct names up to this many (and bytes of names) are ranked beside the rows, more of them by range partitions
FEW_NAMES = 10_000
NAME_BYTES = 1 << 20


def name_ranks(rows: DataFrame, name: str) -> DataFrame:
    """The distinct non-null values of a text column in the order of their code points: ``value, place`` (from 1).

    Values are counted before they are shuffled, so a hot one costs a row per
    task.  Many values are ranked over range partitions, like any large table.
    """
    values = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct()
    return global_rank(values, ["value"], "hilbert-names").select("value", (F.col("rank") + 1).alias("place"))


def with_places(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with each named text column replaced by the place of its value among the distinct ones (null stays null).

    A table of places is broadcast only when its rows and bytes have been
    counted and are few; otherwise rows meet it through a join on the value,
    which adaptive execution splits where a value is hot.
    """
    for name in names:
        places = name_ranks(rows, name)
        n, size = places.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
        if n <= FEW_NAMES and size <= NAME_BYTES:
            places = F.broadcast(places)
        places = places.select(F.col("value").alias("__value"), F.col("place").cast("double").alias("__place"))
        joined = rows.join(places, F.col(name) == F.col("__value"), "left")
        rows = joined.withColumn(name, F.col("__place")).drop("__value", "__place")
    return rows


def quantise(rows: DataFrame, dims: dict[str, Column], bits: int = BITS) -> dict[str, Column]:
    """Per dimension, the cell (0 to 2**bits - 1) of its value: cut at quantiles of all rows, nulls in cell 0.

    The cuts are the only thing that reaches the driver: 2**bits - 1 numbers per dimension.
    """
    fractions = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(c.cast("double"), fractions, 10_000).alias(n) for n, c in dims.items()]).first()

    def cell(name: str, value: Column) -> Column:
        below = [(value.cast("double") > cut).cast("int") for cut in sorted(set(cuts[name] or []))]
        return F.coalesce(sum(below, F.lit(0)), F.lit(0))

    return {name: cell(name, value) for name, value in dims.items()}


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus eight."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def hilbert_order(docs: DataFrame, dims: dict[str, Column], keep: dict[str, Column], tie: list[str], bits: int = BITS) -> DataFrame:
    """``keep`` columns with the curve index as ``hilbert`` and the place of each row in curve order as ``rank``.

    A dimension is a number or a text; texts count by the rank of their whole
    value among the distinct ones, so names that begin alike lie apart.  Rows
    of one cell are ordered by ``tie`` (names in ``keep``).  The source is read
    once; ranks, quantiles, cells and order come from a narrow table.
    """
    values = {f"__{name}": value for name, value in dims.items()}
    narrow = cut_lineage(docs.select(*[c.alias(n) for n, c in (keep | values).items()]), "hilbert-values")
    named = [n for n, kind in narrow.dtypes if n in values and kind == "string"]
    narrow = cut_lineage(with_places(narrow, named), "hilbert-places") if named else narrow
    cells = quantise(narrow, {name: F.col(name) for name in values}, bits)
    indexed = narrow.select(*keep, hilbert_index(list(cells.values()), bits).alias("hilbert"))
    return global_rank(indexed, ["hilbert", *tie], "hilbert")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All documents in ``shards`` runs of the Hilbert curve through source, language and size.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert``.
    The law is ``rows``: shard counts differ by one at most, whatever the data;
    a cell that holds a third of all rows is cut like any other run.  Within a
    cell, equal texts follow each other.  Null or empty texts have size 8 and
    checksum 0, null metadata lies in the first cell, repeated rows get a slot
    each, an empty table gives no rows.  ``grown_shard`` is null, as it belongs
    to another law.
    """
    text, size = F.coalesce("text", F.lit("")), text_size(F.col("text"))
    ranked = hilbert_order(
        docs,
        {"source": F.col("source"), "lang": F.col("lang"), "size": size},
        {"doc_id": F.col("doc_id"), "size": size, "text_crc32": F.crc32(text)},
        ["text_crc32", "size", "doc_id"],
        bits,
    )
    total = ranked.agg(F.count("*").alias("__total"))
    placed = ranked.join(F.broadcast(total)).withColumn("__shard", F.floor(F.expr(f"rank * {shards} div __total")))
    first = F.expr(f"(__shard * __total + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def shard_ranges(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard, the least and greatest value of each column: what a reader needs to skip shards."""
    ends = [fn(c).alias(f"{side}_{c}") for c in columns for side, fn in (("min", F.min), ("max", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *ends)
