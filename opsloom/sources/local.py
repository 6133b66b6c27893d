"""Folders of many small files on a file system that is mounted everywhere (``file:``).

Hadoop's local file system starts a process for each file it makes, and a
listing there is held by the driver.  Here tasks write, list and read the files
themselves.  Every other file system is left to Spark's readers and writers.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: files that a task reads, about
FILES_A_TASK = 512
#: bytes that a task reads, about (a larger file alone)
BYTES_A_TASK = 64 * 1024 * 1024
#: bytes of files that a batch holds, about, and files at most
_BATCH_BYTES, _BATCH_FILES = 16 * 1024 * 1024, 1000
#: folders that a task lists, about, and fewer than which are opened by the driver to find more
_FOLDERS = 32
_LISTED = 10_000
#: as Spark names the folder of a null or empty value, and the characters it escapes in the others
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_PATTERN = re.compile(r"[{}\[\]*?\\]")


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path of the mounted file system without its scheme, or None: of another file system, or a pattern of paths."""
    if not isinstance(path, str) or _PATTERN.search(path):
        return None
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(given).toUri().getPath() if system.getUri().getScheme() == "file" else None


# --- writing ----------------------------------------------------------------
def group_names(*columns: str) -> list:
    """The text by which each column of a group names its folder, before its characters are escaped."""
    return [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(_NO_VALUE)).alias(c) for c in columns]


def write_groups(lines: DataFrame, root: str, suffix: str, head: str = "", tail: str = "") -> None:
    """A file for each group of rows, in a folder ``column=value/...`` below ``root``: ``head``, its lines, ``tail``.

    The last column is the lines with their ends, the others are group names
    (:func:`group_names`).  Rows of a group follow each other in a partition.  A
    file is put in place when it is whole, under a name that a repeated task
    gives it again.
    """
    columns = lines.columns[:-1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}{suffix}"
        group, file, files = None, None, 0

        def end() -> None:
            file.write(tail.encode())
            file.close()
            os.replace(file.name, os.path.join(os.path.dirname(file.name), name))

        try:
            for batch in batches:
                groups = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
                text = batch.column(len(columns)).cast(pa.large_binary())
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = memoryview(text.buffers()[2] or b"")
                begins = [i for i, g in enumerate(groups) if i == 0 or g != groups[i - 1]]
                for begin, stop in zip(begins, [*begins[1:], len(groups)]):
                    if groups[begin] != group:
                        if file is not None:
                            end()
                        group, files = groups[begin], files + 1
                        folder = os.path.join(root, *(f"{c}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for c, v in zip(columns, group)))
                        os.makedirs(folder, exist_ok=True)
                        file = open(os.path.join(folder, f".{name}.{uuid.uuid4().hex}"), "wb")  # noqa: SIM115 - closed with its group
                        file.write(head.encode())
                    file.write(data[ends[begin] : ends[stop]])
            if file is not None:
                end()
        finally:
            if file is not None:
                file.close()
        yield pa.RecordBatch.from_arrays([pa.array([files])], ["files"])

    os.makedirs(root, exist_ok=True)
    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


# --- listing ----------------------------------------------------------------
def _hidden(name: str) -> bool:
    """As Spark's listing has it."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _opened(entry: os.DirEntry) -> bool:
    """Whether a folder is looked into, as Spark does."""
    return entry.is_dir() and (not _hidden(entry.name) or entry.name.startswith(("_common_metadata", "_metadata")))


def _folders(folder: str) -> list[str]:
    with os.scandir(folder) as entries:
        return [e.path for e in entries if _opened(e)]


def _files(folder: str, deep: bool) -> Iterator[tuple[str, int]]:
    with os.scandir(folder) as entries:
        found = sorted(entries, key=lambda e: e.name)
    for entry in found:
        if entry.is_dir():
            yield from _files(entry.path, True) if deep and _opened(entry) else ()
            continue
        try:
            yield entry.path, entry.stat().st_size
        except FileNotFoundError:  # a link to nothing, or just removed
            continue


def list_below(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """``path, length`` of the files with some suffixes (of any letter case) below a folder, or of one file; tasks list them.

    Hidden files and empty ones are left out, as Spark's readers do.  The driver only opens folders until there are enough for the tasks, and
    holds no file.
    """
    wanted = re.compile("(?:" + "|".join(map(re.escape, suffixes)) + r")\Z", re.IGNORECASE | re.ASCII)
    flat: list[str] = []
    deep = [root] if os.path.isdir(root) else []
    while deep and len(deep) < _FOLDERS:
        flat += deep
        deep = [child for folder in deep for child in _folders(folder)]
    places = [(p, False) for p in flat] + [(p, True) for p in deep] or [(root, False)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_files() -> Iterator[tuple[str, int]]:
            for batch in batches:
                for place, below in zip(*(c.to_pylist() for c in batch.columns)):
                    yield from _files(place, below) if os.path.isdir(place) else [(place, os.stat(place).st_size)]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["path", "length"])

        held: list[tuple[str, int]] = []
        for path, length in all_files():
            if length and wanted.search(path) and not _hidden(os.path.basename(path)):
                held.append((path, length))
            if len(held) == _LISTED:
                yield out()
                held = []
        yield out()

    tasks = max(-(-len(places) // _FOLDERS), min(len(places), spark.sparkContext.defaultParallelism))
    given = spark.createDataFrame(places, "path string, deep boolean")
    return given.repartition(tasks).mapInArrow(listed, "path string, length long")


# --- reading ----------------------------------------------------------------
def contents(files: DataFrame) -> DataFrame:
    """``source_path, raw`` of listed files (``source_path, length``); a task reads a bounded number of files and bytes."""
    told = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(told["files"], cores), -(-told["files"] // FILES_A_TASK), -(-told["bytes"] // BYTES_A_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["source_path", "raw"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as file:
                    raw = file.read()
                if paths and (size + len(raw) > _BATCH_BYTES or len(paths) == _BATCH_FILES):
                    yield out()
                    paths, held, size = [], [], 0
                paths.append(path)
                held.append(raw)
                size += len(raw)
        if paths:
            yield out()

    return files.select("source_path").repartition(tasks, "source_path").mapInArrow(read, "source_path string, raw binary")
