"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Lengths are whole numbers up to the capacity, so best fit can place all pieces
of one length together: the only thing the driver sees is the histogram of
lengths, and it hands back runs of bins.  The tasks then look up each piece's
bin from its rank within its length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsloom.llm.shared import global_rank
from opsloom.session import cut_lineage

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"

#: texts of Latin letters and common marks: both libraries class these characters alike
_LATIN = re.compile(r"[^\x00-ɏ‐-‧€]")


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts by a byte-level BPE vocabulary file.

    Latin-script texts go through the faster of two libraries, with the ranks
    of the same vocabulary; all others, and texts that spell a special token,
    through the one that defines the ids.  Tests hold the two together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        self.special = []
        ranks_file = re.sub(r"\.json$", ".tiktoken", path)
        try:
            with open(ranks_file, "rb") as lines:
                ranks = dict(self._rank(line) for line in lines)
        except FileNotFoundError:
            return
        import public_tokenizers
        import tiktoken

        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _rank(line: bytes) -> tuple[bytes, int]:
        import base64

        token, rank = line.split()
        return base64.b64decode(token), int(rank)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _LATIN.search(text) or any(t in text for t in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens: full pieces after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every text.

    A null text is empty: its only token is the end id.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path(tokenizer))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encoder.ids(text or ""), END_ID], dtype="<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.tolist()) if with_ids else row)
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


class CapacityTree:
    """Which remaining capacities have open bins: a segment tree that finds the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.leaves
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` with an open bin."""
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over a histogram of lengths; the runs of each length and the number of bins.

    A run ``(rank, bin, offset, per_bin)`` says: from that rank on, pieces of
    this length go ``per_bin`` at a time into consecutive bins, from ``bin`` and
    ``offset`` on.  Bins with equal free space form intervals.  The tightest
    bin stays the tightest until a piece no longer fits, so each bin of an
    interval takes ``free // length`` pieces before the next one: the same
    packing as piece by piece, in steps that do not grow with the corpus.
    """
    tree = CapacityTree(capacity)
    free: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0

    def put(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            free[remaining].append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        left, rank, placed = histogram[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, count = bins, -(-left // per)
                bins += count
            else:
                (first, count), per = free[room].popleft(), room // length
                tree.add(room, -count)
            full = min(count, left // per)
            if full:
                placed.append((rank, first, capacity - room, per))
                put(room - per * length, first, full)
                rank, left, first, count = rank + full * per, left - full * per, first + full, count - full
            if left and count:
                placed.append((rank, first, capacity - room, per))
                put(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            put(room, first, count)
        runs[length] = placed
    return runs, bins


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length, ...``) by global best-fit decreasing."""
    pieces = cut_lineage(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit(histogram, capacity)
    base, first_rank = 0, {}
    for length in sorted(histogram):
        first_rank[length] = base
        base += histogram[length]
    # bounded by the capacity, not by the corpus; one copy for each executor
    plan = pieces.sparkSession.sparkContext.broadcast(
        {n: (first_rank[n], np.array(r, dtype=np.int64)) for n, r in runs.items()}
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                start, table = plan.value[int(n)]
                at = rank[own] - start
                run = table[np.searchsorted(table[:, 0], at, side="right") - 1]
                inside = at - run[:, 0]
                sequence[own] = run[:, 1] + inside // run[:, 3]
                offset[own] = run[:, 2] + inside % run[:, 3] * n
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    ranked = global_rank(pieces, ["length", "doc_id", "piece", "ids_crc32"], "ranked-pieces")
    return ranked.mapInArrow(place, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """All texts as token pieces in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Only texts longer than a sequence are cut.  A null or empty text is one
    piece of one token; repeated rows are packed once each; an empty table
    gives no pieces; other columns are left aside.
    """
    return pack_pieces(token_pieces(docs, tokenizer, capacity), capacity)
