"""The trie of conversation prefixes, with count-min screening of prefix digests.

A conversation is the sequence of its turns; every distinct sequence of first
*d* turns is a node.  Most prefixes belong to one conversation only.  A
count-min sketch of all prefix digests proves that for nearly all of them (an
estimate of one cannot be too small), so their nodes are written where the
conversation lies; only prefixes that may be shared are shuffled and grouped
exactly.

No statistic needs a walk over the trie.  Nodes along a conversation are owned
by their smallest member, and once a conversation owns a node it owns all
deeper ones on its path.  Sums over a subtree are therefore sums over its
members of what each knows of its own path: where its ownership begins and
whether it ends in a leaf it owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.operators.skew import lookup
from opsloom.session import cut_lineage

#: turns taken over from the base conversation: fewer than this
HEADS = 6
#: conversations that share a base
FAMILY = 100

# --- ordering: rows of a conversation lie together, whatever their number -----------------

_START, _HEAD, _OWN, _SUMMARY = 0, 1, 2, 3
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_WRAP = 1 << 64


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, points``: turns without their texts; the digest is that of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(body.cast("binary"))).alias("digest"),
        F.length(text).alias("points"),
    )


def _taken_over(conv_id: Column) -> Column:
    """How many turns of its base a conversation begins with, at most."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt_rows(conversations: DataFrame, families: bool = True) -> DataFrame:
    """Rows in the order of rebuilt conversations: ``conv_id, kind, turn, digest, points, skip``.

    One start row a conversation, then the turns taken over from its base,
    then all its own turns, of which the first ``skip`` do not count.  Without
    ``families`` conversations stay as they are.
    """
    turns = cut_lineage(_turns(conversations), "turns")
    skip = _taken_over(F.col("conv_id")) if families else F.lit(0)
    own = turns.select("conv_id", F.lit(_OWN).alias("kind"), "turn", "digest", "points", skip.alias("skip"))
    ids = turns.select("conv_id").distinct()
    starts = ids.select("conv_id", F.lit(_START), F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(0), skip)
    if not families:
        return own.union(starts)
    # the first few turns of each base: cut in each partition before the shuffle
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = (
        turns.where(F.col("conv_id") % FAMILY == 0)
        .withColumn("__at", F.row_number().over(order))
        .where(F.col("__at") < HEADS)
        .select(F.col("conv_id").alias("__base"), "__at", "digest", "points")
    )
    members = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("__base"), skip.alias("skip"))
    lent = members.join(heads, "__base").where(F.col("__at") <= F.col("skip"))
    lent = lent.select("conv_id", F.lit(_HEAD), F.col("__at").cast("long"), "digest", "points", "skip")
    return own.union(starts).union(lent)


class _Powers:
    """Powers of the two bases, as many as were asked for; all arithmetic is modulo 2**64."""

    def __init__(self):
        self.known = np.ones((2, 1), np.uint64)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        top = int(exponents.max(initial=0))
        if top >= self.known.shape[1]:
            size = 1 << (top + 1).bit_length()
            steps = np.ones((2, size), np.uint64)
            steps[0, 1:], steps[1, 1:] = np.uint64(_BASES[0]), np.uint64(_BASES[1])
            self.known = np.multiply.accumulate(steps, axis=1)
        return self.known[:, exponents]


_PLACED = (
    "conv_id long, part int, open boolean, kind int, at long, depth long, "
    "a long, b long, pa long, pb long, points long, upto long, last boolean, own long, heads long, skip int"
)
_PLACED_NAMES = [c.split()[0] for c in _PLACED.split(", ")]
_PLACED_TYPES = [
    {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _PLACED.split(", ")
]


def _halves(digests: pa.Array) -> np.ndarray:
    """16-byte digests as two rows of numbers; zeros for null."""
    filled = digests.fill_null(bytes(16)).cast(pa.binary(16))
    flat = np.frombuffer(filled.buffers()[1], "<u8", 2 * len(filled), 16 * filled.offset)
    return flat.reshape(-1, 2).T.copy()


class _Walk:
    """One task's walk along its sorted rows, batch by batch, with the state of the conversation it is in.

    A prefix digest is the sum of turn digests times powers of a base, so that
    a stretch of a conversation can be digested before its beginning is known.
    """

    def __init__(self, part: int):
        self.part = part
        self.powers = _Powers()
        self.conv: int | None = None
        self.open = False
        self.held: dict | None = None  # the last row that counts, until its successor is known

    def _summary(self) -> dict:
        return {
            "conv_id": [self.conv], "open": [self.open], "kind": [_SUMMARY], "at": [self.at], "depth": [self.depth],
            "a": self.sum[:1], "b": self.sum[1:], "pa": [0], "pb": [0], "points": [0], "upto": [self.upto],
            "last": [None], "own": [self.own], "heads": [self.heads], "skip": [self.skip],
        }

    def _out(self, columns: dict) -> pa.RecordBatch:
        n = len(columns["conv_id"])
        columns["part"] = [self.part] * n

        def array(name: str, dtype: pa.DataType) -> pa.Array:
            values = columns[name]
            if isinstance(values, np.ndarray) and values.dtype == np.uint64:
                values = values.view(np.int64)
            return pa.array(values, dtype)

        return pa.RecordBatch.from_arrays([array(c, t) for c, t in zip(_PLACED_NAMES, _PLACED_TYPES)], _PLACED_NAMES)

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        conv = batch.column("conv_id").to_numpy()
        kind = batch.column("kind").to_numpy()
        points = batch.column("points").to_numpy().astype(np.int64)
        skip = batch.column("skip").to_numpy()
        turn = _halves(batch.column("digest"))
        n = len(conv)
        if not n:
            return
        if self.conv is None:
            self.conv, self.open = int(conv[0]), bool(kind[0] != _START)
            self.at = self.depth = self.own = self.heads = self.upto = 0
            self.sum, self.skip = np.zeros(2, np.uint64), int(skip[0])
        head = np.concatenate(([conv[0] != self.conv], conv[1:] != conv[:-1]))
        group = np.cumsum(head)
        cont = group == 0  # rows of the conversation the batch before ended in
        firsts = np.flatnonzero(head)
        base = np.concatenate(([0], firsts))

        def running(values: np.ndarray, before) -> np.ndarray:
            """Sums within each conversation, up to and with each row."""
            sums = np.cumsum(values, dtype=values.dtype)
            start = np.where(base > 0, sums[np.maximum(base, 1) - 1], 0).astype(values.dtype)
            out = sums - start[group]
            out[cont] += values.dtype.type(before)
            return out

        own = running((kind == _OWN).astype(np.int64), self.own)
        heads = running((kind == _HEAD).astype(np.int64), self.heads)
        open_rows = cont & self.open
        counts = ((kind != _START) & ((kind != _OWN) | (own > skip))) | open_rows
        depth = running(counts.astype(np.int64), self.depth)
        term = np.where(counts, turn * self.powers(np.maximum(depth - 1, 0)), np.uint64(0))
        a, b = running(term[0], self.sum[0]), running(term[1], self.sum[1])
        length = np.where(counts, points, 0)
        upto = running(length, self.upto)

        kept = np.flatnonzero(counts | (kind == _START))
        columns = {
            "conv_id": conv[kept], "open": open_rows[kept], "kind": kind[kept], "at": depth[kept] - 1, "depth": depth[kept],
            "a": a[kept], "b": b[kept], "pa": (a - term[0])[kept], "pb": (b - term[1])[kept],
            "points": length[kept], "upto": upto[kept], "own": own[kept], "heads": heads[kept], "skip": skip[kept],
        }
        if self.open and not cont.all():  # the conversation that began in an earlier part ends here
            if cont.any():
                at = np.flatnonzero(cont)[-1]
                self._remember(at, own, heads, depth, a, b, upto, skip)
            yield self._out(self._summary())
            self.open = False
        self.conv = int(conv[-1])
        self._remember(n - 1, own, heads, depth, a, b, upto, skip)
        if len(kept):
            if self.held is not None:
                columns = {c: np.concatenate((self.held[c], v)) for c, v in columns.items()}
            ends = columns["conv_id"][1:] != columns["conv_id"][:-1]
            self.held = {c: v[-1:] for c, v in columns.items()}
            if len(ends):
                yield self._out({c: v[:-1] for c, v in columns.items()} | {"last": ends})

    def _remember(self, i, own, heads, depth, a, b, upto, skip) -> None:
        self.own, self.heads, self.depth, self.at = int(own[i]), int(heads[i]), int(depth[i]), int(depth[i])
        self.sum, self.upto, self.skip = np.array([a[i], b[i]], np.uint64), int(upto[i]), int(skip[i])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.conv is None:
            return
        if self.held is not None:
            # of the conversation the part ends in: whether it goes on is not known here
            ended = bool(self.held["conv_id"][0] != self.conv)
            yield self._out(dict(self.held) | {"last": [True if ended else None]})
        yield self._out(self._summary())


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk(TaskContext.get().partitionId())
    for batch in batches:
        yield from walk.take(batch)
    yield from walk.close()


def _inverse(base: int, k: int) -> int:
    return pow(pow(base, k, _WRAP), -1, _WRAP)


def _carries(summaries: list, firsts: list) -> dict[int, dict]:
    """What each part must know of the parts before it; at most two summaries and eleven first rows come from each part."""
    opening: dict[int, list] = {}
    for r in sorted(firsts, key=lambda r: (r["part"], r["at"])):
        opening.setdefault(r["part"], []).append(r)
    carries: dict[int, dict] = {}
    state, touched = None, []
    unsigned = lambda r: (r["a"] % _WRAP, r["b"] % _WRAP)

    def ended() -> None:
        for part, edge in touched:
            carries.setdefault(part, {})[edge] = state["depth"]

    for r in sorted(summaries, key=lambda r: (r["part"], not r["open"])):
        part = r["part"]
        if not r["open"]:
            if state is not None:
                ended()
            state = {"depth": r["depth"], "sum": unsigned(r), "upto": r["upto"], "own": r["own"], "skip": r["skip"]}
            touched = [(part, "last_depth")]
            continue
        rows = opening.get(part, [])
        lent = sum(x["kind"] == _HEAD for x in rows)
        gone = min(max(0, state["skip"] - state["own"]), r["own"])

        def upto(i: int) -> tuple[tuple[int, int], int]:
            """Digest and length of the first ``i`` rows of the stretch."""
            return (unsigned(rows[i - 1]), rows[i - 1]["upto"]) if i else ((0, 0), 0)

        before, through = upto(lent), upto(lent + gone)
        carries.setdefault(part, {}).update(
            depth=state["depth"], sum=state["sum"], upto=state["upto"], lent=lent, gone=gone, before=before, through=through
        )
        touched.append((part, "open_depth"))
        total = unsigned(r)
        parts = [
            before[0][j] + _inverse(_BASES[j], gone) * (total[j] - through[0][j]) for j in range(2)
        ]
        moved = tuple((state["sum"][j] + pow(_BASES[j], state["depth"], _WRAP) * parts[j]) % _WRAP for j in range(2))
        state = {
            "depth": state["depth"] + r["depth"] - gone,
            "sum": moved,
            "upto": state["upto"] + before[1] + r["upto"] - through[1],
            "own": state["own"] + r["own"],
            "skip": state["skip"],
        }
    if state is not None:
        ended()
    return carries


_PREFIX = ["conv_id", "depth", "a", "b", "pa", "pb", "points", "upto", "last"]
_PREFIX_SCHEMA = "conv_id long, depth long, a long, b long, pa long, pb long, points long, upto long, last boolean"


def prefixes(rows: DataFrame) -> DataFrame:
    """All prefixes of all conversations: ``conv_id, depth, a, b, pa, pb, points, upto, last``.

    ``(a, b)`` is the digest of the prefix, ``(pa, pb)`` that of the prefix
    before it, ``points`` the length of its last text, ``upto`` of all its
    texts, ``last`` whether the conversation ends there.  Rows are cut into
    ranges of conversation and turn, so a conversation of any size lies in as
    many parts as it fills; parts that begin inside one are completed by what
    the parts before them sum up to.
    """
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select("conv_id", "kind", "digest", "points", "skip").mapInArrow(_place, _PLACED), "placed")
    # some rows for each part
    summaries = placed.where(F.col("kind") == _SUMMARY).collect()
    firsts = placed.where(F.col("open") & (F.col("kind") != _SUMMARY) & (F.col("at") < 2 * HEADS)).collect()
    carries = rows.sparkSession.sparkContext.broadcast(_carries(summaries, firsts))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "open", "at", "kind", *_PREFIX[:-1])}
            col = {c: v.copy() for c, v in col.items()}
            told = batch.column("last")
            unknown = told.is_null().to_numpy(zero_copy_only=False) & ~col["open"]
            last = told.fill_null(False).to_numpy(zero_copy_only=False).copy()
            keep = np.ones(len(last), bool)
            for part in np.unique(col["part"][unknown]):
                own = unknown & (col["part"] == part)
                last[own] = col["depth"][own] == carries.value[int(part)]["last_depth"]
            for part in np.unique(col["part"][col["open"]]):
                own = np.flatnonzero(col["open"] & (col["part"] == part))
                c = carries.value[int(part)]
                at, lent, gone = col["at"][own], c["lent"], c["gone"]
                keep[own] = (at < lent) | (at >= lent + gone)
                behind = at >= lent + gone
                scale = powers(np.array([c["depth"]]))[:, 0]
                for j, names in enumerate((("a", "pa"), ("b", "pb"))):
                    for column in names:
                        value = col[column][own].view(np.uint64)
                        moved = np.uint64(c["before"][0][j]) + np.uint64(_inverse(_BASES[j], gone)) * (
                            value - np.uint64(c["through"][0][j])
                        )
                        value = np.uint64(c["sum"][j]) + scale[j] * np.where(behind, moved, value)
                        col[column][own] = value.view(np.int64)
                col["depth"][own] += c["depth"] - np.where(behind, gone, 0)
                col["upto"][own] += c["upto"] + np.where(behind, c["before"][1] - c["through"][1], 0)
                last[own] = col["depth"][own] == c["open_depth"]
            columns = [pa.array(col[c][keep], pa.int64()) for c in _PREFIX[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(last[keep], pa.bool_())], _PREFIX)

    return placed.where(F.col("kind") != _SUMMARY).mapInArrow(complete, _PREFIX_SCHEMA)


# --- screening ----------------------------------------------------------------------------

#: cells of a sketch row for each prefix, and the most a row may have (two bits each in the tasks, one when sent)
CELLS = 4
MOST_BITS = 26
_ROWS = 2
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS
_PENDING = 1 << 21


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch."""
    return [(x.view(np.uint64) * np.uint64(f) >> np.uint64(64 - bits)).astype(np.int64) for x, f in zip((a, b), _BASES)]


def _packed(bitmap: np.ndarray) -> bytes:
    """A block's bitmap, or its set places where those are fewer bytes."""
    at = np.flatnonzero(bitmap)
    return b"s" + at.astype("<u2").tobytes() if 2 * len(at) < _BLOCK // 8 else b"d" + np.packbits(bitmap).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(bool)
    out = np.zeros(_BLOCK, bool)
    out[np.frombuffer(data, "<u2", offset=1)] = True
    return out


def _sketch(found: DataFrame, bits: int) -> dict[tuple[int, int], np.ndarray]:
    """Which cells count two or more prefixes: blocks of bits by row and block number.

    Counters stop at two, for only an estimate of one matters.  Tasks count
    their own prefixes and send the cells of each block as places or as bits,
    whichever is less; blocks are added up one after the other.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((_ROWS, 1 << bits), np.uint8)
        pending: list[list[np.ndarray]] = [[] for _ in range(_ROWS)]

        def settle() -> None:
            for row, cells in enumerate(pending):
                if cells:
                    at, n = np.unique(np.concatenate(cells), return_counts=True)
                    counters[row, at] = np.minimum(2, counters[row, at] + np.minimum(n, 2))
                    cells.clear()

        waiting = 0
        for batch in batches:
            for row, cells in enumerate(_cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), bits)):
                pending[row].append(cells)
            waiting += batch.num_rows
            if waiting > _PENDING:
                settle()
                waiting = 0
        settle()
        for row in range(_ROWS):
            for block in range(0, 1 << bits, _BLOCK):
                own = counters[row, block : block + _BLOCK]
                if own.any():
                    own = np.pad(own, (0, _BLOCK - len(own)))
                    columns = [[row], [block >> _BLOCK_BITS], [_packed(own > 0)], [_packed(own > 1)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["row", "block", "once", "twice"]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [np.packbits(twice).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[:3])], ["row", "block", "bits"])

        for batch in batches:
            for row, block, ones, twos in zip(*(c.to_pylist() for c in batch.columns)):
                ones, twos = _unpacked(ones), _unpacked(twos)
                if (row, block) == key:
                    twice |= twos | (once & ones)
                    once |= ones
                else:
                    if key is not None:
                        yield out()
                    key, once, twice = (row, block), ones, twos
        if key is not None:
            yield out()

    counted = found.select("a", "b").mapInArrow(count, "row int, block int, once binary, twice binary")
    added = counted.repartition("row", "block").sortWithinPartitions("row", "block")
    # at most 2 ** (MOST_BITS - 2) bytes
    blocks = added.mapInArrow(add, "row int, block int, bits binary").collect()
    return {(r["row"], r["block"]): np.frombuffer(bytes(r["bits"]), np.uint8) for r in blocks}


def screened(found: DataFrame, bits: int | None = None) -> DataFrame:
    """Prefixes with ``shared`` and ``parent_shared``: whether a digest may belong to several conversations.

    False is a proof.  The sketch has ``CELLS`` cells for each prefix and row
    up to ``2 ** MOST_BITS``; with more prefixes than that it proves less, and
    more prefixes are grouped, but the result stays the same.
    """
    if bits is None:
        bits = min(MOST_BITS, max(10, (CELLS * found.count()).bit_length()))
    blocks = found.sparkSession.sparkContext.broadcast(_sketch(found, bits))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((_ROWS, max(_BLOCK, 1 << bits) // 8), np.uint8)
        for (row, block), data in blocks.value.items():
            rows[row, block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = data

        def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.ones(len(a), bool)
            for row, cell in zip(rows, _cells(a, b, bits)):
                out &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            return out

        for batch in batches:
            col = {c: batch.column(c).to_numpy() for c in ("a", "b", "pa", "pb")}
            flags = [shared(col["a"], col["b"]), shared(col["pa"], col["pb"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, flags)], [*_PREFIX, "shared", "parent_shared"])

    return found.mapInArrow(flag, _PREFIX_SCHEMA + ", shared boolean, parent_shared boolean")


# --- exact grouping of what may be shared -------------------------------------------------

_PIECE = 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _ends_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` for rows ``a, b, conv_id``: the digest of each group's ids in ascending order, joined by commas.

    Ids are sorted over ranges and joined to pieces there, a group of any size
    in as many tasks as it fills; the digest, sequential by nature, then reads
    the pieces of a group one by one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, key, ids, size = TaskContext.get().partitionId(), 0, None, [], 0

        def out() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [part], [n], [",".join(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and ((a, b) != key or size > _PIECE):
                    yield out()
                    n, ids, size = n + 1, [], 0
                key = (a, b)
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if key is not None:
            yield out()

    names = ["a", "b", "part", "n", "piece"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (state.hexdigest(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece"))):
                if (a, b) == key:
                    state.update(b"," + piece.encode())
                else:
                    if key is not None:
                        yield out()
                    key, state = (a, b), hashlib.sha256(piece.encode())
        if key is not None:
            yield out()

    order = ["a", "b", "conv_id"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = cut_lineage(ranged.mapInArrow(join, "a long, b long, part int, n long, piece string"), "end-pieces")
    near = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "part", "n")
    return near.mapInArrow(digest, "a long, b long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, families: bool = True, bits: int | None = None) -> DataFrame:
    """All nodes of the prefix trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn`` (null first; ties by the digest of role and
    text); null roles and texts are empty.  A node is named by its depth and
    its smallest member.  With ``families``, conversation c begins with the
    first crc32(c) % 6 turns of conversation c - c % 100 in place of its own;
    without, conversations stay as they are.  ``saved_tokens`` are the code
    points of last texts that a cache of prefixes saves in the subtree.

    Rows without a ``conv_id`` belong to no conversation and are left out;
    repeated rows are turns of their own; a conversation without turns is a
    member of the root; an empty table has no nodes; very long texts enter by
    digest and length only; other columns are left aside.  ``bits`` sets the
    size of the sketch; results do not depend on it.
    """
    found = cut_lineage(prefixes(rebuilt_rows(conversations, families)), "prefixes")
    flagged = screened(found, bits)
    node = ["a", "b"]
    maybe = flagged.where("shared").withColumn("node", F.concat_ws(":", *node)).drop("shared")
    maybe = cut_lineage(maybe, "maybe-shared")
    single = cut_lineage(flagged.where(~F.col("shared")).drop("shared"), "single")

    groups = maybe.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"))
    groups = cut_lineage(groups, "groups")
    members = cut_lineage(lookup(maybe, groups, "node", ["owner", "n_convs"]), "members")
    owned = members.where(F.col("owner") == F.col("conv_id"))

    # a node is the child of its parent once: told by its owner, or by its only member
    tops = single.where("parent_shared")
    births = owned.where(F.col("depth") > 0).select("pa", "pb").unionByName(tops.select("pa", "pb"))
    children = births.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(owned.join(children, node, "left").fillna(0, ["n_children"]), "nodes")

    # where each conversation's ownership begins, and whether it ends in a leaf of its own
    begins = members.groupBy("conv_id").agg(F.max(F.when(F.col("owner") != F.col("conv_id"), F.col("upto"))).alias("__foreign"))
    alone = single.where("last").select("conv_id")
    leaves = nodes.where(F.col("last") & (F.col("n_children") == 0)).select("conv_id").unionByName(alone)
    known = begins.join(leaves.withColumn("__leaf", F.lit(1)), "conv_id", "left")
    known = cut_lineage(known.fillna(0, ["__foreign", "__leaf"]), "ownership")
    told = members.join(known, "conv_id").groupBy(*node).agg(
        F.sum("__leaf").cast("long").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("__foreign") - F.col("upto") + F.col("points"))).cast("long").alias("saved_tokens"),
    )

    # the parent of a node lies on its owner's path
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("__above"))
    ends = _ends_digests(maybe.where("last"))
    parent = F.when(F.col("depth") > 0, F.coalesce("__above", "conv_id"))
    shared_nodes = (
        nodes.join(told, node)
        .join(ends, node, "left")
        .join(above, ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )

    def local(rows: DataFrame, parent: Column) -> DataFrame:
        one = F.lit(1).cast("long")
        own_end = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
        return rows.select(
            "conv_id",
            "depth",
            parent.alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(F.col("last"), own_end).otherwise(_NO_ENDS).alias("ends_sha256"),
        )

    tails = local(single.where(~F.col("parent_shared")), F.when(F.col("depth") > 0, F.col("conv_id")))
    top_nodes = local(tops.join(above, ["conv_id", "depth"], "left"), parent)
    return shared_nodes.unionByName(tails).unionByName(top_nodes)
