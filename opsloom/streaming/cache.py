"""An expiring cache as keyed stream state, served in event-time order at bounded memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: a key's rows are put in order slice by slice; one slice of one key must fit into memory
SLICE_SECONDS = 3600


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class ExpiringCache(StatefulProcessor):
    """One value a key, its time of storing, and an event-time timer that forgets it.

    Rows of a key come in any order, frame by frame.  A key whose rows fit
    into one frame is served at once.  Otherwise the frames are laid into the
    state store by slice of time, and the slices are served one after the
    other, so that a key with a third of all rows needs no more memory than
    its busiest slice.
    """

    def __init__(self, kept: list[str], ttl_ms: int, slice_ms: int):
        self.kept, self.ttl_ms, self.slice_ms = kept, ttl_ms, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string, put_at long")
        self.slices = handle.getMapState("slices", "slice long, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, put_at = tuple(self.held.get()) if self.held.exists() else (None, -1)
        before = put_at
        first, laid = None, {}

        def lay(frame: pd.DataFrame) -> None:
            for at, own in frame.groupby(frame["at_ms"] // self.slice_ms):
                part = laid.get(int(at), 0)
                self.slices.updateValue((int(at), part), (_packed(own),))
                laid[int(at)] = part + 1

        for frame in rows:
            if first is None and not laid:
                first = frame
                continue
            if first is not None:
                lay(first)
                first = None
            lay(frame)

        def ordered() -> Iterator[pd.DataFrame]:
            if first is not None:
                yield first
            for at in sorted(laid):
                parts = [(at, part) for part in range(laid[at])]
                yield pd.concat([_unpacked(self.slices.getValue(p)[0]) for p in parts], ignore_index=True)
                for p in parts:
                    self.slices.removeKey(p)

        for batch in ordered():
            batch = batch.sort_values(["at_ms", "puts"], ascending=[True, False], kind="stable")
            found = []
            for at, puts, given in zip(batch["at_ms"], batch["puts"], batch["given"]):
                if puts:
                    held, put_at = given, int(at)
                found.append(held if put_at >= 0 and at - put_at < self.ttl_ms else None)
            out = batch[self.kept].assign(cached=found)
            yield out[~batch["puts"].astype(bool)]
        if put_at != before:
            self._remember(held, put_at, before, timerValues.getCurrentWatermarkInMs())

    def _remember(self, held: str | None, put_at: int, before: int, watermark: int) -> None:
        if before >= 0:
            self.handle.deleteTimer(before + self.ttl_ms)
        if put_at + self.ttl_ms > watermark:
            self.held.update((held, put_at))
            self.handle.registerTimer(put_at + self.ttl_ms)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def cached_reads(
    rows: DataFrame, key: str, value: str, is_put: str, ttl_seconds: int, keep: Sequence[str] = (), ts: str = "ts", delay: str = "1 hour",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each read with the value put last under its key, if that was less than the TTL before.

    ``rows``: ``key``, ``value`` (text), ``is_put``, ``ts`` and the ``keep``
    columns that name a read.  Returns ``keep`` and ``cached`` (null: a miss),
    one row per read.  At equal times puts come first.  When the watermark
    passes the expiry of a value, its state is dropped.  Needs the RocksDB
    state store (:func:`opsloom.streaming.events.run_available` with
    ``rocksdb``).
    """
    kept = list(keep)
    types = dict(rows.dtypes)
    zoned = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # plain names: frames of stateful operators do not keep others
    plain = [f"kept_{i}" for i in range(len(kept))]
    staged = zoned.select(
        F.col(ts).alias("moment"),
        *[F.col(c).alias(p) for c, p in zip(kept, plain)],
        F.col(key).cast("string").alias("owner"),
        F.unix_millis(ts).alias("at_ms"),
        F.col(is_put).alias("puts"),
        F.col(value).alias("given"),
    )
    schema = "".join(f"{p} {types[c]}, " for c, p in zip(kept, plain)) + "cached string"
    processor = ExpiringCache(plain, ttl_seconds * 1000, slice_seconds * 1000)
    served = staged.groupBy("owner").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return served.select(*[F.col(p).alias(c) for c, p in zip(kept, plain)], "cached")
