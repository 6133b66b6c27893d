"""An audit log that takes each batch exactly once, in files closed by their bytes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from opsloom.operators.audit import AUDIT_SCHEMA, MAX_FILE_BYTES
from opsloom.operators.versioned import names_in, put_once

_COLUMNS = "day string, file string, value string"


def _rolled(records: DataFrame, max_file_bytes: int) -> DataFrame:
    """Records (``day, value``) with the file each goes to: a task closes a day's file before the record that would overfill it.

    A record larger than the limit has a file to itself.
    """

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number: dict[str | None, int] = {}
        filled: dict[str | None, int] = {}
        for batch in batches:
            files = []
            for day, size in zip(batch.column("day").to_pylist(), batch.column("size").to_pylist()):
                if day not in number or filled[day] + size > max_file_bytes:
                    number[day] = number.get(day, -1) + 1
                    filled[day] = 0
                filled[day] += size
                files.append(f"{part:06d}-{number[day]:06d}")
            yield pa.RecordBatch.from_arrays([batch.column("day"), pa.array(files, pa.string()), batch.column("value")], ["day", "file", "value"])

    sized = records.select("day", "value", (F.octet_length("value") + 1).cast("long").alias("size"))
    return sized.mapInArrow(roll, _COLUMNS)


def commit_batch(entries: DataFrame, path: str, batch: int, max_file_bytes: int = MAX_FILE_BYTES) -> bool:
    """Append a batch of audit entries as JSON lines, one folder a day; False if the batch is there already.

    Files are written to a fresh folder, and a small commit file then names
    it.  A batch that broke, or was written twice at once, counts with the one
    folder its commit names; a batch sent again adds nothing.
    """
    spark = entries.sparkSession
    name = f"{batch:012d}.json"
    if name in names_in(spark, f"{path}/commits"):
        return False
    folder = f"data/{uuid.uuid4().hex}"
    fields = [F.col(c.name) for c in spark.createDataFrame([], AUDIT_SCHEMA).schema]
    records = entries.select(
        F.substring("timestamp", 1, 10).alias("day"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    )
    # tasks move their files themselves, not the driver one by one; a broken write is never named
    moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    _rolled(records, max_file_bytes).write.options(**moved).partitionBy("day", "file").text(f"{path}/{folder}")
    return put_once(spark, f"{path}/commits", name, json.dumps({"batch": batch, "folder": folder}))


def _folders(spark: SparkSession, path: str) -> list[str]:
    names = names_in(spark, f"{path}/commits")
    if not names:
        return []
    told = spark.read.text([f"{path}/commits/{n}" for n in names]).collect()  # one short line a batch
    return sorted(f"{path}/{json.loads(r[0])['folder']}" for r in told)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed entries; folders of broken batches are not read."""
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], AUDIT_SCHEMA)
    lines = [spark.read.option("recursiveFileLookup", "true").text(f) for f in folders]
    rows = lines[0] if len(lines) == 1 else spark.read.option("recursiveFileLookup", "true").text(folders)
    return rows.select(F.from_json("value", AUDIT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).where("e.event_type IS NOT NULL").select("e.*")


def log_files(spark: SparkSession, path: str, above: int | None = None) -> DataFrame:
    """Committed files: ``path, bytes, records``; with ``above``, those of more bytes: the others are not read."""
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], "path string, bytes long, records long")
    rows = spark.read.option("recursiveFileLookup", "true").text(folders)
    if above is not None:
        rows = rows.where(F.col("_metadata.file_size") > above)
    return rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("records"))


def follow(stream: DataFrame, path: str, checkpoint: str, max_file_bytes: int = MAX_FILE_BYTES, **trigger) -> StreamingQuery:
    """Write a stream of audit entries to the log; after a restart, batches that were committed are not written again."""

    def write(batch: DataFrame, number: int) -> None:
        commit_batch(batch, path, number, max_file_bytes)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
