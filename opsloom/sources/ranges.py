"""Large text files as byte ranges: a data source whose partitions are planned ranges of bounded size.

A text, CSV or JSON-lines file of any size is cut into ranges; a record belongs
to the range it begins in, wherever it ends.  Rows are pieces of whole records
with partial statistics that add up to the file's.  Whether a range of a CSV
file begins inside quotes depends on all bytes before it, so the quotes of the
ranges are counted first, by the tasks, and one bit a range is handed to the
second scan.

Files that are not read, and ranges or records that cannot be decoded or
parsed, come out as rows with a ``reason``; nothing disappears silently.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from opsloom.sources.files import EXTENSION_TYPES, extension_type

RANGE_BYTES = 64 * 1024 * 1024
#: records are gathered to pieces of about this many bytes
PIECE_BYTES = 1024 * 1024
#: how each kind of file is cut; all other extensions are listed with a reason
FORMATS = {".txt": "text", ".md": "text", ".conf": "text", ".cfg": "text", ".config": "text", ".sla": "text", ".csv": "csv", ".jsonl": "json", ".ndjson": "json"}
_BLOCK = 1024 * 1024
_QUOTE = b'"'

_SCHEMA = "source_path string, format string, range int, start long, content string, records long, chars long, columns array<string>, quotes long, reason string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()]


@dataclass
class ByteRange(InputPartition):
    """One task's part of a file; a file that is not read has an empty range and a reason."""

    path: str
    format: str
    number: int
    start: int
    stop: int
    quoted: bool
    reason: str | None = None


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # with one slash or three
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        self.counting = options.get("count") == "quotes"
        self.formats = FORMATS | json.loads(options.get("formats", "{}"))
        self.quoted = {(p, n) for p, n in json.loads(options.get("quoted", "[]"))}

    def partitions(self) -> list[ByteRange]:
        """Ranges of all files below the path, from their sizes alone; no content is read here."""
        system, root = _filesystem(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for info in sorted((f for f in files if f.type == fs.FileType.File), key=lambda f: f.path):
            if not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            kind = self.formats.get(_suffix(info.path))
            if kind is None:
                why = "read as a whole file" if _suffix(info.path) in EXTENSION_TYPES else "type is not known"
                out += [] if self.counting else [ByteRange(info.path, "other", 0, 0, 0, False, why)]
                continue
            if self.counting and kind != "csv":
                continue
            for number, start in enumerate(range(0, max(1, info.size), self.range_bytes)):
                stop = min(start + self.range_bytes, info.size)
                out.append(ByteRange(info.path, kind, number, start, stop, (info.path, number) in self.quoted))
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file was planned
            return
        if partition.reason:
            yield _batch(partition, partition.start, None, 0, reason=partition.reason)
            return
        system, _ = _filesystem(self.path)
        try:
            with system.open_input_file(partition.path) as file:
                yield from self._counted(file, partition) if self.counting else self._pieces(file, partition)
        except OSError as error:
            yield _batch(partition, partition.start, None, 0, reason=f"cannot be read: {type(error).__name__}")

    def _counted(self, file, p: ByteRange) -> Iterator[pa.RecordBatch]:
        file.seek(p.start)
        quotes, left = 0, p.stop - p.start
        while left and (block := file.read(min(_BLOCK, left))):
            quotes += block.count(_QUOTE)
            left -= len(block)
        yield _batch(p, p.start, None, 0, quotes=quotes)

    def _pieces(self, file, p: ByteRange) -> Iterator[pa.RecordBatch]:
        held, at, size = [], None, 0
        for start, record in _records(file, p):
            if held and size + len(record) > self.piece_bytes:
                yield _decoded(p, at, held)
                held, at, size = [], None, 0
            at = start if at is None else at
            held.append(record)
            size += len(record)
        if held:
            yield _decoded(p, at, held)
        elif p.number == 0 and p.start == p.stop:
            yield _decoded(p, 0, [b""])


def _batch(p: ByteRange, start, content, records, chars=0, columns=None, quotes=None, reason=None) -> pa.RecordBatch:
    row = (p.path, p.format, p.number, start, content, records, chars, columns, quotes, reason)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)


def _records(file, p: ByteRange) -> Iterator[tuple[int, bytes]]:
    """The records that begin in a range, with their line ends, and where each begins.

    A record ends at a line feed outside quotes (quotes count in CSV only).
    Reading begins one byte early: a range that begins right behind a line end
    owns the record there, any other range skips to the next one.
    """
    quoting = p.format == "csv"
    quoted = p.quoted
    at = p.start
    skipping = False
    if p.start:
        file.seek(p.start - 1)
        line_ended = file.read(1) == b"\n"
        skipping = quoted or not line_ended
    else:
        file.seek(0)
    parts: list[bytes] = []
    began, buffer, pos = at, b"", 0
    while True:
        cut = buffer.find(b"\n", pos)
        piece = buffer[pos : cut + 1] if cut >= 0 else buffer[pos:]
        if piece:
            parts.append(piece)
            at += len(piece)
            pos += len(piece)
            if quoting and piece.count(_QUOTE) % 2:
                quoted = not quoted
        if cut >= 0:
            if quoted:
                continue  # a line feed inside quotes
            if not skipping:
                yield began, b"".join(parts)
            skipping, parts, began = False, [], at
            if at >= p.stop:
                return
            continue
        buffer, pos = file.read(_BLOCK), 0
        if not buffer:
            if parts and not skipping:
                yield began, b"".join(parts)
            return


def _decoded(p: ByteRange, start: int, held: list[bytes]) -> pa.RecordBatch:
    raw = b"".join(held)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as error:
        return _batch(p, start, None, 0, reason=f"not UTF-8 at byte {start + error.start}")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if p.format == "text":
        return _batch(p, start, text, text.count("\n"), len(text))
    if p.format == "csv":
        try:
            rows = list(csv.reader(io.StringIO(text), strict=True))
        except csv.Error as error:
            return _batch(p, start, text, 0, len(text), reason=f"not CSV: {error}")
        columns = rows[0] if start == 0 and rows else None
        return _batch(p, start, text, len(rows) - (columns is not None), len(text), columns)
    good, bad, keys = 0, None, {}
    for line in text.split("\n"):
        if line.strip():
            try:
                value = json.loads(line)
                good += 1
                keys.update(dict.fromkeys(value if isinstance(value, dict) else ()))
            except ValueError as error:
                bad = bad or f"not JSON: {str(error).split(':')[0]}"
    return _batch(p, start, text, good, len(text), list(keys), reason=bad)


class RangedFiles(DataSource):
    """Format ``ranged_files``; options ``path``, ``glob``, ``rangeBytes``, ``pieceBytes``, ``formats`` (extension to format, as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_ranges(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, piece_bytes: int = PIECE_BYTES, glob: str = "*", formats: dict[str, str] | None = None
) -> DataFrame:
    """Pieces of all text, CSV and JSON-lines files below ``path``.

    ``source_path, format, range, start`` (byte), ``content`` (whole records,
    every line end a line feed), ``records`` (text: line feeds; CSV: rows
    without the header; JSON: objects that parse), ``chars``, ``columns`` (CSV:
    the header, in the first piece; JSON: the keys met) and ``reason``.  No
    file is too large; a single record must fit into a task's memory.  An
    empty file is one empty piece.  A missing path raises.  ``formats`` adds
    extensions to, or changes, how files are cut.

    For CSV a first scan counts the quotes of each range; one small row a
    range comes to the driver.
    """
    spark.dataSource.register(RangedFiles)

    def scan(**more: str) -> DataFrame:
        options = {"path": path, "glob": glob, "rangeBytes": str(range_bytes), "pieceBytes": str(piece_bytes), "formats": json.dumps(formats or {})} | more
        return spark.read.format("ranged_files").options(**options).load()

    quoted, open_in = [], {}
    counts = scan(count="quotes").select("source_path", "range", "quotes").orderBy("source_path", "range")
    for r in counts.collect():
        inside = open_in.get(r["source_path"], False)
        if inside:
            quoted.append((r["source_path"], r["range"]))
        open_in[r["source_path"]] = inside != bool((r["quotes"] or 0) % 2)
    return scan(quoted=json.dumps(quoted)).drop("quotes")


def file_statistics(pieces: DataFrame) -> DataFrame:
    """One row a file from its pieces: ``source_path, format, pieces, ranges, records, chars, columns, reasons``.

    Partial counts are added before the shuffle, so a file of any size costs
    one row a task.  Columns are in sorted order.
    """
    # the pieces of a file name few different sets of columns
    columns = F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns"))))
    counts = pieces.groupBy("source_path", "format").agg(
        F.count("*").alias("pieces"),
        F.count_distinct("range").alias("ranges"),
        F.sum("records").alias("records"),
        F.sum("chars").alias("chars"),
        columns.alias("columns"),
        F.sort_array(F.collect_set("reason")).alias("reasons"),
    )
    return counts.withColumn("document_type", extension_type(F.col("source_path")))


def rejected_pieces(pieces: DataFrame) -> DataFrame:
    """Where something could not be read: ``source_path, range, start, reason``."""
    return pieces.where(F.col("reason").isNotNull()).select("source_path", "range", "start", "reason")
