"""Token-id files compressed by Re-Pair: frequent pairs of symbols become rules, shard by shard.

Documents are range-partitioned and sorted by id, and each task writes its
texts' ids as shards of about a million ids.  A shard carries its own grammar
and the length of every rule's expansion, so a document, or a stretch of one,
is decoded without touching the rest of its shard, and shards without a wanted
document are skipped by the statistics of the files they lie in.

A file is Parquet with one row a shard (``part, shard, before, n_docs,
n_tokens, min_doc, max_doc, data``; ``before`` counts the ids of earlier shards
of its part).  ``data`` is little-endian and reads in order:

* ``RPG1``, then 32-bit numbers of documents, terminals, rules and bytes a
  symbol (2 or 4), and the 64-bit number of symbols;
* for each document: its id (64 bits), whether it has one (8 bits), its number
  of ids and of symbols (64 bits each);
* the id of each terminal (32 bits): symbol *s* below their number stands for it;
* for each rule its two symbols, and the length of its expansion (32 bits);
* the symbols of all documents, one after the other; no rule spans two documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsloom.llm.packing import END_ID, TOKENIZER, Encoder, tokenizer_path
from opsloom.session import scratch_dir

#: ids after which a shard is closed; a longer text has a shard of its own
SHARD_IDS = 1 << 20
#: a pair is replaced from so many occurrences on: a rule costs about three symbols
LEAST = 4
#: pairs replaced together in one round, and rounds at most
RULES_A_ROUND = 4096
ROUNDS = 12
#: a round takes pairs down to this fraction of the most frequent one's count
SPREAD = 16
#: and the last round is one that leaves more than this fraction of the symbols
SETTLED = 0.95

_MAGIC = b"RPG1"
_HEAD = "<4sIIIIQ"
_SLOTS = 1 << 16


def _pairs(symbols: np.ndarray, ends: np.ndarray, n_symbols: int) -> np.ndarray:
    """The pair that begins at each symbol as one number; all ones where a document ends (``ends``) between its halves."""
    width, shift = (np.uint32, 16) if n_symbols <= 1 << 16 else (np.uint64, 32)
    pairs = symbols[:-1].astype(width)
    pairs <<= width(shift)
    pairs |= symbols[1:]
    pairs[ends[(ends > 0) & (ends < len(symbols))] - 1] = np.iinfo(width).max
    return pairs


def _frequent(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs and their counts, most frequent first."""
    none = np.iinfo(pairs.dtype).max
    ordered = np.sort(pairs)
    ordered = ordered[: np.searchsorted(ordered, none)]
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    often = np.flatnonzero(counts >= max(LEAST, int(counts.max()) // SPREAD))
    best = often[np.argsort(-counts[often], kind="stable")[:RULES_A_ROUND]]
    return ordered[first[best]], counts[best]


def _matches(pairs: np.ndarray, wanted: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a wanted pair begins, and which one: by a hashed table, in which the more frequent pair keeps a slot.

    A pair that loses its slot waits for the next round, which hashes otherwise.
    """
    factor = np.uint32(0x9E3779B1 + 2 * turn * 0x3C6EF372 & 0xFFFFFFFF)

    def slot(p: np.ndarray) -> np.ndarray:
        low = p if p.dtype == np.uint32 else (p ^ (p >> np.uint64(29))).astype(np.uint32)
        return (low * factor) >> np.uint32(16)

    table = np.full(_SLOTS, -1, np.int32)
    table[slot(wanted[::-1])] = np.arange(len(wanted) - 1, -1, -1, dtype=np.int32)
    which = table[slot(pairs)]
    at = np.flatnonzero(which >= 0)
    which = which[at]
    own = wanted[which] == pairs[at]
    return at[own], which[own]


def _chosen(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of the overlapping occurrences, those ahead of both neighbours: the more frequent pair, then the earlier place.

    In a run of one pair (``aaaa``) every second place counts as ahead.
    """
    near = np.diff(at) == 1
    starts = np.concatenate(([True], ~(near & (which[1:] == which[:-1]))))
    places = np.arange(len(at))
    run = np.maximum.accumulate(np.where(starts, places, 0))
    key = -2 * which.astype(np.int64) + 1 - (places - run) % 2
    lowest = np.iinfo(np.int64).min
    left = np.concatenate(([lowest], np.where(near, key[:-1], lowest)))
    right = np.concatenate((np.where(near, key[1:], lowest), [lowest]))
    return (key > left) & (key >= right)


def compress(ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """A grammar for documents of ``sizes`` ids each: ``terminals, left, right, lengths, symbols, sizes``.

    Each round counts all pairs of neighbouring symbols inside the documents
    and replaces the frequent ones (at least a sixteenth as frequent as the
    most frequent, and ``LEAST``) by new symbols, until none is left or after
    ``ROUNDS`` rounds; what stays unreplaced only costs space.
    """
    present = np.zeros(int(ids.max(initial=0)) + 1, bool)
    present[ids] = True
    terminals = np.flatnonzero(present).astype(np.uint32)
    number = (np.cumsum(present) - 1).astype(np.uint32)
    symbols, ends = number[ids], np.cumsum(sizes)
    left, right, lengths = [], [], [np.ones(len(terminals), np.int64)]
    n = len(terminals)
    for turn in range(ROUNDS):
        if len(symbols) < 2:
            break
        pairs = _pairs(symbols, ends, n)
        wanted, counts = _frequent(pairs)
        if not len(wanted):
            break
        at, which = _matches(pairs, wanted, turn)
        won = _chosen(at, which)
        at, which = at[won], which[won]
        used = np.bincount(which, minlength=len(wanted))
        worth = used >= LEAST - 1
        if not worth.any():
            break
        kept = worth[which]
        at, which = at[kept], which[kept]
        new = (n + np.cumsum(worth) - 1).astype(np.uint32)
        shift = 16 if wanted.dtype == np.uint32 else 32
        a, b = wanted[worth] >> wanted.dtype.type(shift), wanted[worth] & wanted.dtype.type((1 << shift) - 1)
        left.append(a.astype(np.uint32))
        right.append(b.astype(np.uint32))
        known = np.concatenate(lengths)
        lengths.append(known[a] + known[b])
        n += int(worth.sum())
        symbols[at] = new[which]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        before = len(symbols)
        symbols, ends = symbols[stay], ends - np.searchsorted(at + 1, ends)
        if len(symbols) > SETTLED * before:
            break
    none = np.zeros(0, np.uint32)
    return {
        "terminals": terminals,
        "left": np.concatenate([none, *left]),
        "right": np.concatenate([none, *right]),
        "lengths": np.concatenate(lengths),
        "symbols": symbols,
        "sizes": np.diff(ends, prepend=0),
    }


def to_bytes(doc_ids: list[int | None], sizes: np.ndarray, grammar: dict[str, np.ndarray]) -> bytes:
    """A shard in its file format."""
    n_rules, n_terminals = len(grammar["left"]), len(grammar["terminals"])
    width = 2 if n_terminals + n_rules <= 1 << 16 else 4
    symbol = f"<u{width}"
    head = struct.pack(_HEAD, _MAGIC, len(doc_ids), n_terminals, n_rules, width, len(grammar["symbols"]))
    columns = (
        np.array([i or 0 for i in doc_ids], "<i8"),
        np.array([i is not None for i in doc_ids], "u1"),
        sizes.astype("<u8"),
        grammar["sizes"].astype("<u8"),
        grammar["terminals"].astype("<u4"),
        grammar["left"].astype(symbol),
        grammar["right"].astype(symbol),
        grammar["lengths"][n_terminals:].astype("<u4"),
        grammar["symbols"].astype(symbol),
    )
    return head + b"".join(c.tobytes() for c in columns)


class Shard:
    """A shard read from its bytes; documents are numbered from 0 in file order."""

    def __init__(self, data: bytes):
        magic, n_docs, n_terminals, n_rules, width, n_symbols = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def column(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        symbol = f"<u{width}"
        ids, known = column("<i8", n_docs), column("u1", n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.sizes = column("<u8", n_docs).astype(np.int64)
        self._ends = np.cumsum(column("<u8", n_docs).astype(np.int64))
        self.terminals = column("<u4", n_terminals)
        self._left, self._right = column(symbol, n_rules), column(symbol, n_rules)
        self.lengths = np.concatenate((np.ones(n_terminals, np.int64), column("<u4", n_rules).astype(np.int64)))
        self.symbols = column(symbol, n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a stretch of symbols: rules are replaced by their halves, all of a layer at once."""
        n = len(self.terminals)
        out = symbols.astype(np.int64)
        while (rules := out >= n).any():
            at = np.repeat(np.arange(len(out)), 1 + rules)
            second = np.concatenate(([False], at[1:] == at[:-1]))
            out = out[at]
            halves = np.flatnonzero(out >= n)
            rule = out[halves] - n
            out[halves] = np.where(second[halves], self._right[rule], self._left[rule])
        return self.terminals[out]

    def _document(self, k: int) -> np.ndarray:
        return self.symbols[self._ends[k - 1] if k else 0 : self._ends[k]]

    def ids(self, k: int, at: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids of document ``k`` from its id ``at`` on: only the symbols that cover them are expanded."""
        symbols = self._document(k)
        stop = self.sizes[k] if n is None else min(at + n, self.sizes[k])
        if at >= stop:
            return self.terminals[:0]
        upto = np.cumsum(self.lengths[symbols])
        first, last = np.searchsorted(upto, at, side="right"), np.searchsorted(upto, stop)
        skipped = upto[first - 1] if first else 0
        return self.expand(symbols[first : last + 1])[at - skipped : stop - skipped]

    def all_ids(self) -> np.ndarray:
        """The ids of all documents: every rule is expanded once, then copied to its places."""
        n = len(self.terminals)
        flat = np.concatenate((self.terminals, self.expand(np.arange(n, len(self.lengths)))))
        total = int(self.sizes.sum())
        width = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        lengths = self.lengths.astype(width)
        start = np.cumsum(lengths, dtype=width) - lengths
        sizes = lengths[self.symbols]
        at = np.repeat(start[self.symbols] - np.cumsum(sizes, dtype=width) + sizes, sizes)
        at += np.arange(total, dtype=width)
        return flat[at]


_SHARDS = "part int, shard int, before long, n_docs int, n_tokens long, min_doc long, max_doc long, data binary"
_SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_SHARD_NAMES = [c.split()[0] for c in _SHARDS.split(", ")]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts (each ended by ``END_ID``) to ``path``, in ascending order of ``doc_id``.

    A null text is empty: its only id is the end id.  A null ``doc_id`` comes
    first.  Rows that share a ``doc_id`` follow each other in the order of
    their texts' hashes; whole repeated rows are written once each.  A very
    long text fills a shard of its own.  An empty table gives files without
    shards; other columns are left aside.  A task that is run again writes the
    same shards, and only committed files are read.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path(tokenizer))
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        n = shard = before = 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(ids) for _, ids in held], np.int64)
            names = [i for i, _ in held]
            known = [i for i in names if i is not None]
            data = to_bytes(names, sizes, compress(np.concatenate([ids for _, ids in held]), sizes))
            row = (part, shard, before, len(held), int(sizes.sum()), min(known, default=None), max(known, default=None), data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD_TYPES)], _SHARD_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encoder.ids(text or ""), END_ID], dtype=np.uint32)
                if held and n + len(ids) > shard_ids:
                    yield closed()
                    held, n, shard, before = [], 0, shard + 1, before + n
                held.append((doc_id, ids))
                n += len(ids)
        if held:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    rows.mapInArrow(shards, _SHARDS).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """All shards with ``start``: how many ids lie before each, in its part and in the parts before it."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    # one row for each task that wrote; the shards themselves do not move
    placed = shards.join(F.broadcast(parts), F.col("part") == F.col("__part"))
    return placed.select("data", (F.col("__before") + F.col("before")).alias("start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, by decoding all shards."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, before in zip(batch.column("data"), batch.column("start").to_pylist()):
                shard = Shard(data.as_py())
                ids = shard.all_ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, shard.sizes)]
                columns = (shard.doc_ids, before + ends - shard.sizes, shard.sizes, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return _placed(spark, path).mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(spark: SparkSession, path: str, doc_id: int, at: int = 0, n: int | None = None) -> DataFrame:
    """``doc_id, ids``: up to ``n`` ids of one document from its id ``at`` on.

    Files and shards that cannot hold the document are skipped by their least
    and greatest id; in its shard only the symbols that cover the stretch are
    expanded.  A document that is not there gives no row, a repeated one gives
    one row each.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                shard = Shard(data.as_py())
                rows = [shard.ids(k, at, n).tolist() for k, i in enumerate(shard.doc_ids) if i == doc_id]
                columns = [pa.array([doc_id] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    shards = spark.read.schema(_SHARDS).parquet(path)
    near = shards.where((F.col("min_doc") <= doc_id) & (F.col("max_doc") >= doc_id))
    return near.select("data").mapInArrow(found, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the ids of all documents to fresh files in the shared folder, and return what is read back from them."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
