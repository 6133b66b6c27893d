"""Documents to chunks: one narrow pass, strategy chosen per row by document type.

Section, configuration-block and packing logic are array expressions.  Only
the recursive character splitter runs in Python (Arrow batches), and only for
the rows that need it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from opsloom.functions.text import chunk_id, nonempty, strip
from opsloom.operators.skew import explode_rows

# --- fixed values -----------------------------------------------------------
PROSE_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
#: plain strings, not patterns: the splitter searches for them literally
MARKDOWN_SEPARATORS = [
    "\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "",
]
CONFIG_SEPARATORS = ["\n\n", "\n!", "\n", " "]
#: document type: strategy, chunk size, overlap
CHUNK_PLAN = {
    "pdf": ("prose", 1000, 200),
    "docx": ("prose", 1000, 200),
    "txt": ("prose", 1000, 200),
    "md": ("markdown", 1000, 100),
    "config": ("network_config", 2000, 100),
    "csv": ("prose", 500, 50),
    "json": ("prose", 1500, 100),
    "xml": ("prose", 1500, 100),
    "sla": ("semantic", 2000, 1),
}
DEFAULT_PLAN = ("prose", 1000, 200)
MIN_SECTION = 200
MAX_SECTION = 2000
SECTION_PATTERNS = [
    r"(?:^|\n)((?:\d+\.)+\s+[A-Z][^\n]+)",
    r"(?:^|\n)((?:Article|Section|Clause)\s+\d+[:\.\s][^\n]+)",
    r"(?:^|\n)((?:APPENDIX|SCHEDULE|EXHIBIT)\s+[A-Z0-9]+[:\.\s][^\n]*)",
    r"(?:^|\n)((?:Definition|Term)[s]?:?\s*\n)",
]
SENTENCE_GAP = r"(?<=[.!?])\s+"
#: "to the next block of the same kind, a bang line, or the end"
BLOCK_PATTERNS = [
    r"(interface\s+[\w/.-]+[\s\S]*?)(?=\ninterface\s|\n!|\z)",
    r"(router\s+\w+[\s\S]*?)(?=\nrouter\s|\n!|\z)",
    r"(policy-map\s+[\w-]+[\s\S]*?)(?=\npolicy-map\s|\n!|\z)",
    r"(class-map\s+[\w-]+[\s\S]*?)(?=\nclass-map\s|\n!|\z)",
    r"(vlan\s+\d+[\s\S]*?)(?=\nvlan\s|\n!|\z)",
    r"(access-list\s+[\w-]+[\s\S]*?)(?=\naccess-list\s|\n!|\z)",
    r"(\[[\w:.-]+\][\s\S]*?)(?=\n\[|\z)",
]
BLOCK_TYPES = [
    ("interface", "interface"),
    ("router", "routing"),
    ("policy-map", "qos_policy"),
    ("class-map", "traffic_class"),
    ("vlan", "vlan"),
    ("access-list", "acl"),
    ("[", "ini_section"),
]
OTHER_BLOCK_TYPE = "general"
MARKDOWN_HEADER = r"(?dmU)^#{1,6}\s+(.+)$"
# --- end of fixed values ----------------------------------------------------

_SEPARATORS = {"prose": PROSE_SEPARATORS, "markdown": MARKDOWN_SEPARATORS, "network_config": CONFIG_SEPARATORS}
_CHUNK = "struct<content:string,section_header:string,config_block_type:string,chunk_strategy:string>"
# two non-characters around a control code: no text holds this sequence
_MARK, _TITLE_END = "\ufdd0\x01\ufdd1", "\ufdd1\x02\ufdd0"


def _pieces(body: str, mark: str) -> Iterator[str]:
    """Parts of a text, each separator at the start of the part it precedes; characters for no separator."""
    if not mark:
        yield from body
        return
    start, at = 0, body.find(mark)
    while at >= 0:
        if at > start:
            yield body[start:at]
        start, at = at, body.find(mark, at + len(mark))
    if start < len(body):
        yield body[start:]


def iter_chunks(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    """Split at the coarsest separator that occurs, finer ones inside long pieces.

    Each separator stays at the start of the piece it precedes.  Pieces are
    packed up to ``size`` characters; the next chunk repeats the trailing
    pieces of the last one while they fit into ``overlap``.  Chunks come one
    by one: neither all pieces nor all chunks of a text are ever held.
    """
    window: deque[str] = deque()
    held = 0

    def packed() -> Iterator[str]:
        joined = "".join(window).strip()
        if joined:
            yield joined

    def walk(body: str, marks: list[str]) -> Iterator[str]:
        nonlocal held
        at = next((i for i, m in enumerate(marks) if m in body), len(marks) - 1)
        finer = marks[at + 1 :] if marks[at] in body else []
        for piece in _pieces(body, marks[at]):
            n = len(piece)
            if n < size:
                if held + n > size and window:
                    yield from packed()
                    while window and (held > overlap or held + n > size):
                        held -= len(window.popleft())
                window.append(piece)
                held += n
                continue
            yield from packed()
            window.clear()
            held = 0
            if finer:
                yield from walk(piece, finer)
            else:
                yield piece
        yield from packed()
        window.clear()
        held = 0

    if text:
        yield from walk(text, separators)


def split_recursively(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """All chunks of :func:`iter_chunks`."""
    return list(iter_chunks(text, size, overlap, separators))


#: chunks that leave a task in one batch
CHUNK_BATCH = 1024


def stream_chunks(rows: DataFrame, keep: list[str], text: str, size: str, overlap: str, separators: str) -> DataFrame:
    """``keep`` columns, ``chunk_index`` and ``content``: the recursive splitter as a table function.

    ``size``, ``overlap`` and ``separators`` name columns, so that each row is
    split its own way (``separators``: prose, markdown or network_config).
    Chunks leave a task in batches of 1,024 while the text is still being
    split, so a text of any length needs no array of its chunks.  Null and
    empty texts give no rows; repeated rows give their chunks again.
    """
    given = rows.select(*keep, *[F.col(c).alias(f"__{i}") for i, c in enumerate((text, size, overlap, separators))])
    fields = [given.schema[name] for name in keep]
    schema = T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(keep)
            at, index, content = [], [], []

            def flushed() -> pa.RecordBatch:
                columns = [kept.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
                columns += [pa.array(index, pa.int32()), pa.array(content, pa.string())]
                out = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                for part in (at, index, content):
                    part.clear()
                return out

            for row in range(batch.num_rows):
                t, n, o, kind = (batch.column(f"__{i}")[row].as_py() for i in range(4))
                if t is None:
                    continue
                for i, chunk in enumerate(iter_chunks(t, n, o, _SEPARATORS[kind])):
                    at.append(row)
                    index.append(i)
                    content.append(chunk)
                    if len(at) == CHUNK_BATCH:
                        yield flushed()
            if at:
                yield flushed()

    return given.mapInArrow(split, schema)


@pandas_udf(T.ArrayType(T.StringType()))
def _split_texts(text: pd.Series, kind: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if t is None else split_recursively(t, int(s), int(o), _SEPARATORS[k])
            for t, k, s, o in zip(text, kind, size, overlap)
        ]
    )


def split_texts(text: Column, size: int, overlap: int, separators: str) -> Column:
    """Chunks of a text by the recursive splitter; ``separators`` names one of its three lists."""
    return _split(text, F.lit(separators), F.lit(size), F.lit(overlap))


# planned as non-deterministic so that it runs once, in its own step, and is
# not copied into every expression that uses its result
_split = _split_texts.asNondeterministic()


def section_header(chunk: Column) -> Column:
    """First markdown header of a chunk, or null."""
    return F.nullif(strip(F.regexp_extract(chunk, MARKDOWN_HEADER, 1)), F.lit(""))


def block_type(block: Column) -> Column:
    """Kind of a configuration block, from the start of its first line."""
    first = strip(F.lower(F.substring_index(block, "\n", 1)))
    kind = F.lit(OTHER_BLOCK_TYPE)
    for prefix, name in reversed(BLOCK_TYPES):
        kind = F.when(first.startswith(prefix), name).otherwise(kind)
    return kind


def _pack(items: Column, limit: int, extra: int, joiner: str, carry: int) -> Column:
    """Greedy packing of an array of strings: start a new pack when ``limit`` would be passed.

    ``extra`` is added to each item's length; ``carry`` items (0 or 1) are
    repeated at the start of the next pack.
    """
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, item: Column) -> Column:
        n = F.length(item) + extra
        full = (acc["n"] + n > limit) & (F.size(acc["open"]) > 0)
        kept = F.slice(acc["open"], -1, 1) if carry else none
        kept_n = F.length(F.try_element_at(acc["open"], F.lit(-1))) if carry else F.lit(0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], joiner)))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, kept).otherwise(acc["open"]), F.array(item)).alias("open"),
            (F.when(full, kept_n).otherwise(acc["n"]) + n).alias("n"),
        )

    return F.aggregate(
        items,
        state,
        step,
        lambda acc: F.when(
            F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], joiner)))
        ).otherwise(acc["done"]),
    )


def pack_sentences(text: Column, limit: int = MAX_SECTION) -> Column:
    """Sentences packed up to ``limit`` characters; the last one opens the next pack."""
    return _pack(F.split(text, "(?U)" + SENTENCE_GAP), limit, 0, " ", 1)


def pack_lines(text: Column, limit: int = MAX_SECTION) -> Column:
    """Lines packed up to ``limit`` characters, no overlap."""
    return _pack(F.split(text, "\n"), limit, 1, "\n", 0)


def split_sections(text: Column) -> Column:
    """``array<struct<title, body>>``: text between headers, and the text before them if long."""
    # all patterns start the same way: state it once
    start = "(?:^|\\n)"
    pattern = f"(?dimU){start}(?:" + "|".join(p.removeprefix(start) for p in SECTION_PATTERNS) + ")"
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_TITLE_END}"), _MARK)

    def section(part: Column) -> Column:
        return F.struct(
            strip(F.substring_index(part, _TITLE_END, 1)).alias("title"),
            strip(F.substring_index(part, _TITLE_END, -1)).alias("body"),
        )

    lead = F.get(marked, 0)
    untitled = F.lit(None).cast("string")
    whole = F.array(F.struct(untitled.alias("title"), lead.alias("body")))
    preamble = F.array(F.struct(untitled.alias("title"), strip(lead).alias("body")))
    preamble = F.when(F.length(lead) > MIN_SECTION, preamble).otherwise(F.slice(preamble, 1, 0))
    titled = F.transform(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), section)
    found = F.filter(F.concat(preamble, titled), lambda s: F.length(s["body"]) > 0)
    return F.when(F.size(marked) == 1, whole).otherwise(found)


def semantic_chunks(sections: Column) -> Column:
    """Chunks of sections: short ones dropped, long ones packed by sentences."""

    def pieces(s: Column) -> Column:
        n = F.length(s["body"])
        whole = F.array(s["body"])
        bodies = F.when(n > MAX_SECTION, pack_sentences(s["body"])).when(n >= MIN_SECTION, whole)
        title = F.nullif(s["title"], F.lit(""))
        none = F.lit(None).cast("string")
        return F.transform(
            F.coalesce(bodies, F.array().cast("array<string>")),
            lambda b: F.struct(
                b.alias("content"), title.alias("section_header"),
                none.alias("config_block_type"), F.lit("semantic").alias("chunk_strategy"),
            ).cast(_CHUNK),
        )

    return F.flatten(F.transform(sections, pieces))


def config_blocks(text: Column) -> Column:
    """Distinct configuration blocks in pattern order; long ones packed by lines."""
    found = [F.regexp_extract_all(text, F.lit("(?imU)" + p), F.lit(1)) for p in BLOCK_PATTERNS]
    blocks = F.array_distinct(nonempty(F.transform(F.concat(*found), strip)))
    sized = F.transform(
        blocks, lambda b: F.when(F.length(b) > MAX_SECTION, pack_lines(b)).otherwise(F.array(b))
    )
    return F.flatten(sized)


def _as_chunks(texts: Column, strategy: Column) -> Column:
    none = F.lit(None).cast("string")

    def build(t: Column) -> Column:
        return F.struct(
            t.alias("content"),
            F.when(strategy == "markdown", section_header(t)).otherwise(none).alias("section_header"),
            F.when(strategy == "network_config", block_type(t)).otherwise(none).alias("config_block_type"),
            strategy.alias("chunk_strategy"),
        ).cast(_CHUNK)

    return F.transform(texts, build)


def chunk_plan(document_type: Column, prose_size: int = 1000, prose_overlap: int = 200) -> Column:
    """``struct<strategy, size, overlap>`` of a document type.

    ``prose_size`` and ``prose_overlap`` replace the defaults of pdf, docx and txt.
    """

    def entry(plan: tuple[str, int, int]) -> Column:
        return F.struct(
            F.lit(plan[0]).alias("strategy"), F.lit(plan[1]).alias("size"), F.lit(plan[2]).alias("overlap")
        )

    out = entry(DEFAULT_PLAN)
    for name, plan in CHUNK_PLAN.items():
        if name in ("pdf", "docx", "txt"):
            plan = ("prose", prose_size, prose_overlap)
        out = F.when(document_type == name, entry(plan)).otherwise(out)
    return out


def chunk_documents(
    documents: DataFrame, prose_size: int = 1000, prose_overlap: int = 200, keep: list[str] | None = None
) -> DataFrame:
    """One row per chunk: chunk_id, document_id, chunk_index, content and its labels.

    ``documents``: doc_id, content, document_type (see the sources), plus any
    columns named in ``keep``.  Semantic and configuration documents in which
    nothing is found fall back to the splitter.
    """
    text, plan = F.col("content"), F.col("__plan")
    strategy = plan["strategy"]
    no_texts = F.array().cast("array<string>")
    sections = F.when(strategy == "semantic", split_sections(text))
    staged = (
        documents.withColumn("__plan", chunk_plan(F.col("document_type"), prose_size, prose_overlap))
        .withColumn("__sections", sections)
        .withColumn(
            "__structured",
            F.when(strategy == "semantic", semantic_chunks(F.col("__sections"))).when(
                strategy == "network_config", _as_chunks(config_blocks(text), strategy)
            ),
        )
    )
    # rows that already have chunks pass a null to the splitter and skip it
    needs_split = F.coalesce(F.size("__structured"), F.lit(0)) <= 0
    as_prose = strategy == "semantic"
    split = _split(
        F.when(needs_split, text),
        F.when(as_prose, "prose").otherwise(strategy),
        F.when(as_prose, 1000).otherwise(plan["size"]),
        F.when(as_prose, 200).otherwise(plan["overlap"]),
    )
    label = F.when(as_prose, "prose").otherwise(strategy)
    kept = keep or []
    chunks = F.when(needs_split, _as_chunks(F.coalesce("__split", no_texts), label)).otherwise(F.col("__structured"))
    rows = explode_rows(staged.withColumn("__split", split), ["doc_id", *kept], chunks, "chunk_index", "__c")
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        "chunk_index",
        *kept,
        "__c.*",
    )
