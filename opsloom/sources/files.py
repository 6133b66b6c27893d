"""Files to documents: one row per supported file.

Text formats are decoded and described in the JVM.  CSV, JSON, XML, PDF and
DOCX go through one Arrow batch function, as their exact text forms need a
parser.  Each group is its own scan, limited to its extensions at listing
time, so no file is read twice and unsupported files are never opened.  Files of
a mounted file system are listed and read by the tasks (``sources/local.py``).
"""

from __future__ import annotations

import csv
import io
import json
import os
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from opsloom.functions.text import count_newlines, document_id
from opsloom.sources import local

# --- fixed values -----------------------------------------------------------
EXTENSION_TYPES = {
    ".csv": "csv",
    ".json": "json",
    ".xml": "xml",
    ".pdf": "pdf",
    ".docx": "docx",
    ".txt": "txt",
    ".md": "md",
    ".conf": "config",
    ".cfg": "config",
    ".config": "config",
    ".sla": "sla",
}
SLA_NAME_PATTERNS = [r"sla[_\-\s]", r"service[_\-\s]level", r"agreement", r"contract"]
REGION_PATTERN = r"region[:\s]+(\w+)"
CSV_RULE = "-" * 40
UPLOAD_TYPES = ["application/pdf", "text/plain", "text/csv", "application/json", "application/xml"]
DOCUMENT_VERSION = "1.0"
# --- end of fixed values ----------------------------------------------------

PARSED_TYPES = ["csv", "json", "xml", "docx"]
#: types recognised but not read
UNREAD_TYPES = ["pdf"]
TEXT_TYPES = sorted(set(EXTENSION_TYPES.values()) - set(PARSED_TYPES) - set(UNREAD_TYPES))
DOCUMENT_COLUMNS = [
    "doc_id", "content", "source_path", "document_type", "ingestion_ts", "version", "region", "metadata",
]
_PARSED = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)
_WORDML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# --- column expressions -----------------------------------------------------
def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]+\z", "$1")


def extension_type(path: Column) -> Column:
    """Document type of a path by its extension, or null when unsupported."""
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])
    return F.try_element_at(kinds, file_suffix(path))


def named_like_sla(path: Column) -> Column:
    """The file's stem looks like a service agreement."""
    return F.lower(file_stem(path)).rlike("(?iU)" + "|".join(SLA_NAME_PATTERNS))


def document_type(path: Column) -> Column:
    """Extension type, overridden to ``sla`` by the file name; unsupported stays null."""
    kind = extension_type(path)
    return F.when(kind.isNotNull() & named_like_sla(path), "sla").otherwise(kind)


def accepted_upload(content_type: Column) -> Column:
    return content_type.isin(UPLOAD_TYPES)


def detected_region(content: Column) -> Column:
    """First region tag in a text, or null."""
    return F.nullif(F.regexp_extract(content, "(?iU)" + REGION_PATTERN, 1), F.lit(""))


def text_statistics(content: Column) -> dict[str, Column]:
    """Line count (line feeds plus one), character count and region of a text."""
    return {"line_count": count_newlines(content) + 1, "char_count": F.length(content), "region": detected_region(content)}


def normalized_newlines(text: Column) -> Column:
    """Every line end as a single line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


# --- parsers, one file each -------------------------------------------------
def parse_csv(raw: bytes) -> tuple[str, dict]:
    """Header and rows joined by `` | ``, with a rule below the header."""
    rows = csv.reader(io.StringIO(raw.decode("utf-8"), newline=None))
    header = next(rows, [])
    body = [" | ".join(row) for row in rows]
    text = "\n".join([" | ".join(header), CSV_RULE, *body])
    return text, {"row_count": len(body), "columns": header}


def parse_json(raw: bytes) -> tuple[str, dict]:
    """Indented by two, keys in file order."""
    value = json.loads(raw.decode("utf-8"))
    keys = list(value) if isinstance(value, dict) else None
    return json.dumps(value, indent=2), {"json_type": type(value).__name__, "top_level_keys": keys}


def parse_xml(raw: bytes) -> tuple[str, dict]:
    """The root element written out again; child tags in first-seen order."""
    root = ET.fromstring(raw)
    tags = list(dict.fromkeys(child.tag for child in root))
    return ET.tostring(root, encoding="unicode"), {"root_tag": root.tag, "child_tags": tags}


def parse_docx(raw: bytes) -> tuple[str, dict]:
    """Non-blank paragraphs, then tables with cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(_WORDML + "body")

    breaks = {_WORDML + "tab": "\t", _WORDML + "br": "\n", _WORDML + "cr": "\n"}

    def text_of(paragraph: ET.Element) -> str:
        return "".join(
            (node.text or "") if node.tag == _WORDML + "t" else breaks.get(node.tag, "") for node in paragraph.iter()
        )

    def cell_text(cell: ET.Element) -> str:
        return "\n".join(text_of(p) for p in cell.findall(_WORDML + "p"))

    paragraphs = [t for t in map(text_of, body.findall(_WORDML + "p")) if t.strip()]
    tables = [
        "\n".join(" | ".join(map(cell_text, row.findall(_WORDML + "tc"))) for row in table.findall(_WORDML + "tr"))
        for table in body.findall(_WORDML + "tbl")
    ]
    found = {"paragraph_count": len(paragraphs), "has_tables": bool(tables)}
    return "\n\n".join([*paragraphs, *tables]), found


_PARSERS = {"csv": parse_csv, "json": parse_json, "xml": parse_xml, "docx": parse_docx}


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


@pandas_udf(_PARSED)
def _parse(kind: pd.Series, raw: pd.Series) -> pd.DataFrame:
    contents: list[str | None] = []
    metadata: list[dict | None] = []
    reasons: list[str | None] = []
    for k, r in zip(kind, raw):
        text = found = reason = None
        try:
            text, found = _PARSERS[k](bytes(r))
            text.encode("utf-8")
            found = {name: _as_text(value) for name, value in found.items()}
        except Exception as error:  # noqa: BLE001 - whatever a parser raises is the file's reason
            text, reason = None, f"{type(error).__name__}: {error}"
        contents.append(text)
        metadata.append(found)
        reasons.append(reason)
    return pd.DataFrame({"content": contents, "metadata": metadata, "reason": reasons})


# --- scans ------------------------------------------------------------------
def _glob(types: Iterable[str]) -> str:
    """File-name pattern for the extensions of some types, in any letter case."""
    wanted = [ext for ext, kind in EXTENSION_TYPES.items() if kind in set(types)]
    cased = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in wanted]
    return "*{" + ",".join(cased) + "}"


#: a file is one row, and a row's binary value must stay below two gigabytes
MAX_FILE_BYTES = 1 << 30


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of known types below a folder (or one file).

    Content is read by the scans that use it, and of the files they choose.
    The listing of a mounted file system is no more than a plan for the tasks
    of the scans; that of any other is made here, once however many scans follow.
    """
    root = local.local_path(spark, path)
    if root is not None and os.path.exists(root):
        return local.list_below(spark, root, list(EXTENSION_TYPES))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(set(EXTENSION_TYPES.values())))
        .load(path)
    )


def _by_tasks(files: DataFrame) -> bool:
    """Whether a listing is one of :func:`opsloom.sources.local.list_below`."""
    return "content" not in files.columns


def _chosen(files: DataFrame, types: Iterable[str]) -> DataFrame:
    # a condition on the name alone decides which files a scan opens
    name = F.col("path" if _by_tasks(files) else "_metadata.file_name")
    named = files.where(extension_type(name).isin(sorted(types)))
    return named.withColumn("source_path", F.regexp_replace("path", r"^file:(?://)?(?=/)", ""))


def scan_files(
    spark: SparkSession, path: str, types: Iterable[str], max_bytes: int = MAX_FILE_BYTES, files: DataFrame | None = None
) -> DataFrame:
    """Files of some types below a folder (or one file): path, raw, extension type.

    A missing path raises.  Files above ``max_bytes`` are left out before their
    content is read; :func:`rejected_files` lists them.  ``files`` is a listing
    (:func:`list_files`) to use again.
    """
    listed = list_files(spark, path) if files is None else files
    chosen = _chosen(listed, types).where(F.col("length") <= max_bytes)
    read = local.contents(chosen) if _by_tasks(listed) else chosen.select("source_path", F.col("content").alias("raw"))
    return read.withColumn("__kind", extension_type(F.col("source_path")))


def rejected_files(
    spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, files: DataFrame | None = None
) -> DataFrame:
    """Files that are not loaded for their size or type: source_path, length, reason.  No content is read."""
    listed = list_files(spark, path) if files is None else files
    unread = extension_type(F.col("source_path")).isin(UNREAD_TYPES)
    reason = F.when(unread, "type is not read").when(F.col("length") > max_bytes, "larger than the limit")
    # by name and size alone, so that all other files end at the listing
    name, size = ("path", "length") if _by_tasks(listed) else ("_metadata.file_name", "_metadata.file_size")
    apart = extension_type(F.col(name)).isin(UNREAD_TYPES) | (F.col(size) > max_bytes)
    found = _chosen(listed.where(apart), set(EXTENSION_TYPES.values())).select("source_path", "length")
    return found.withColumn("reason", reason).where(F.col("reason").isNotNull())


def unparsable_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files within the limit whose content cannot be read: source_path, length, reason.

    Together with :func:`rejected_files` these are all files of known types
    that :func:`load_documents` leaves out.
    """
    return read_files(spark, path, max_bytes).where(F.col("reason").isNotNull()).select("source_path", "length", "reason")


def read_files(
    spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, files: DataFrame | None = None
) -> DataFrame:
    """Every file within the limit, read once: source_path, length, content, metadata, and the reason where it cannot be read."""
    listed = list_files(spark, path) if files is None else files
    length = F.octet_length("raw").cast("long").alias("length")
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    texts = scan_files(spark, path, TEXT_TYPES, max_bytes, listed)
    texts = texts.withColumn("content", F.when(valid, normalized_newlines(F.col("raw").cast("string"))))
    stats = text_statistics(F.col("content"))
    counted = F.create_map(
        F.lit("line_count"), stats["line_count"].cast("string"), F.lit("char_count"), stats["char_count"].cast("string")
    )
    tagged = F.when(stats["region"].isNotNull(), F.map_concat(counted, F.create_map(F.lit("region"), stats["region"])))
    reason = F.when(~valid, "not valid UTF-8").alias("reason")
    texts = texts.select("source_path", length, "content", F.coalesce(tagged, counted).alias("metadata"), reason)

    parsed = scan_files(spark, path, PARSED_TYPES, max_bytes, listed).withColumn("__p", _parse(F.col("__kind"), F.col("raw")))
    return texts.unionByName(parsed.select("source_path", length, "__p.content", "__p.metadata", "__p.reason"))


def load_documents(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Documents below a path; files that cannot be read or parsed are left out (:func:`unparsable_files` lists them)."""
    both = read_files(spark, path, max_bytes).where(F.col("reason").isNull())
    source = F.col("source_path")
    flagged = F.map_concat(
        F.col("metadata"), F.create_map(F.lit("detected_as_sla"), named_like_sla(source).cast("string"))
    )
    return both.select(
        document_id(source, F.col("content")).alias("doc_id"),
        "content",
        "source_path",
        document_type(source).alias("document_type"),
        F.current_timestamp().alias("ingestion_ts"),
        F.lit(DOCUMENT_VERSION).alias("version"),
        F.try_element_at("metadata", F.lit("region")).alias("region"),
        flagged.alias("metadata"),
    )
