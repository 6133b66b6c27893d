"""Queries over texts: identity, file types, guardrails, redaction, claims, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import claims as C
from opsloom.functions import guardrails as R
from opsloom.functions import text as T
from opsloom.operators import chunking as K
from opsloom.operators import grounding as G
from opsloom.operators import patterns as P
from opsloom.operators.collections import document_type_counts
from opsloom.operators.skew import explode_rows, lookback
from opsloom.plans.catalog import query, table, texts
from opsloom.plans.derived import derive, derived_sql
from opsloom.plans.sqltext import TRIM, lit, sql_list, tokens_sql
from opsloom.session import scratch_dir
from opsloom.sources import files as S
from opsloom.sources import local as L

FILES = derived_sql("files")
CHAT = derived_sql("chat")


# --- identity, types, statistics --------------------------------------------
@query(
    "document_identity",
    f"""
    SELECT doc_id,
           substr(sha256(source_path || ':' || substr(content, 1, 1000)), 1, 16) AS document_id,
           substr(sha256(source_path || ':' || substr(content, 1, 1000)), 1, 16) || '_' || CAST(doc_id % 7 AS VARCHAR) AS chunk_id,
           'emb:v1:' || substr(md5('model-a'), 1, 8) || ':' || substr(sha256(content), 1, 32) AS cache_key
    FROM {FILES}
    """,
)
def document_identity(spark, sf_dir):
    docs = derive(spark, sf_dir, "files")
    ident = T.document_id(F.col("source_path"), F.col("content"))
    return docs.select(
        "doc_id",
        ident.alias("document_id"),
        T.chunk_id(ident, F.col("doc_id") % 7).alias("chunk_id"),
        T.embedding_cache_key(F.col("content"), "model-a").alias("cache_key"),
    )


_SUFFIX_SQL = "lower(regexp_extract(regexp_extract(source_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_STEM_SQL = "lower(regexp_replace(regexp_extract(source_path, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1'))"
_KIND_SQL = "CASE " + _SUFFIX_SQL + " " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in S.EXTENSION_TYPES.items()) + " END"
_SLA_SQL = f"regexp_matches({_STEM_SQL}, {lit('|'.join(S.SLA_NAME_PATTERNS))})"
_TYPED_SQL = f"""
    SELECT doc_id, suffix, named_like_sla,
           CASE WHEN kind IS NOT NULL AND named_like_sla THEN 'sla' ELSE kind END AS document_type
    FROM (SELECT doc_id, {_SUFFIX_SQL} AS suffix, {_SLA_SQL} AS named_like_sla, {_KIND_SQL} AS kind FROM {FILES})
"""


@query("document_types", _TYPED_SQL)
def document_types(spark, sf_dir):
    path = F.col("source_path")
    return derive(spark, sf_dir, "files").select(
        "doc_id",
        S.file_suffix(path).alias("suffix"),
        S.named_like_sla(path).alias("named_like_sla"),
        S.document_type(path).alias("document_type"),
    )


@query(
    "document_type_counts",
    f"SELECT document_type, count(*) AS documents FROM ({_TYPED_SQL}) WHERE document_type IS NOT NULL GROUP BY 1",
)
def type_counts(spark, sf_dir):
    docs = derive(spark, sf_dir, "files").select(S.document_type(F.col("source_path")).alias("document_type"))
    return document_type_counts(docs.where(F.col("document_type").isNotNull()))


@query(
    "text_statistics",
    """
    SELECT page_id, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count, length(t) AS char_count,
           nullif(regexp_extract(t, '(?i)region[:\\s]+([\\p{L}\\p{N}_]+)', 1), '') AS region
    FROM (SELECT page_id, html || chr(10) || 'Region: r' || CAST(page_id % 9 AS VARCHAR) AS t FROM pages)
    """,
    ints=("line_count", "char_count"),
)
def text_statistics(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages").selectExpr(
        "page_id", "html || chr(10) || 'Region: r' || CAST(page_id % 9 AS STRING) AS t"
    )
    stats = S.text_statistics(F.col("t"))
    return pages.select("page_id", *[c.alias(n) for n, c in stats.items()])


@query(
    "upload_types",
    f"""
    SELECT content_type, content_type IN ({sql_list(S.UPLOAD_TYPES)}) AS accepted, count(*) AS files
    FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json'
                 ELSE 'image/png' END AS content_type FROM pages)
    GROUP BY 1, 2
    """,
)
def upload_types(spark, sf_dir):
    kinds = texts(spark, sf_dir, "pages").selectExpr(
        "CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' "
        "ELSE 'image/png' END AS content_type"
    )
    return kinds.groupBy("content_type", S.accepted_upload(F.col("content_type")).alias("accepted")).agg(
        F.count("*").alias("files")
    )


# --- input screening --------------------------------------------------------
def _risk_sql(t: str) -> str:
    markers = " + ".join(
        f"CASE WHEN contains(lower({t}), {lit(m)}) THEN 0.1::DOUBLE ELSE 0 END" for m in R.RISK_MARKERS
    )
    words = tokens_sql(f"lower({t})")
    return f"""least(
        CASE WHEN length(regexp_replace({t}, '[\\p{{L}}\\p{{N}}\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]', '', 'g')) > length({t}) * 0.3::DOUBLE THEN 0.2::DOUBLE ELSE 0 END
        + CASE WHEN length({t}) - length(replace({t}, chr(10), '')) > 20 THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN len({words}) > 0 AND len(list_distinct({words}))::DOUBLE / len({words}) < 0.3::DOUBLE THEN 0.2::DOUBLE ELSE 0 END
        + {markers}
        + CASE WHEN regexp_matches({t}, {lit(R.BASE64_RUN)}) THEN 0.15::DOUBLE ELSE 0 END, 1.0::DOUBLE)"""


def _screen_sql(source: str, key: str, t: str) -> str:
    injection = lit("(?i)" + "|".join(R.INJECTION_PATTERNS))
    blocked = lit("(?i)" + "|".join(R.BLOCKED_PATTERNS))
    return f"""
    SELECT {key}, verdict IN ('empty', 'safe') AS is_safe,
           CASE verdict WHEN 'long' THEN 'Message exceeds maximum length of 10000 characters'
                WHEN 'injection' THEN 'Potential prompt injection detected'
                WHEN 'blocked' THEN 'Message contains blocked content'
                WHEN 'risky' THEN 'Message flagged as potentially harmful' END AS reason,
           round(CASE verdict WHEN 'empty' THEN 0 WHEN 'long' THEN 0.3 WHEN 'injection' THEN 0.9 WHEN 'blocked' THEN 0.8 ELSE risk END, 6) AS risk_score
    FROM (SELECT {key}, risk, CASE WHEN {t} IS NULL OR {t} = '' THEN 'empty' WHEN length({t}) > 10000 THEN 'long'
                 WHEN regexp_matches({t}, {injection}) THEN 'injection' WHEN regexp_matches({t}, {blocked}) THEN 'blocked'
                 WHEN risk > 0.7::DOUBLE THEN 'risky' ELSE 'safe' END AS verdict
          FROM (SELECT *, {_risk_sql(t)} AS risk FROM {source}))
    """


def _screened(df, key, text):
    checked = df.select(key, R.validate_input(F.col(text)).alias("v")).select(key, "v.*")
    return checked.withColumn("risk_score", F.round("risk_score", 6))


@query("input_screen_documents", _screen_sql("documents", "doc_id", "text"))
def input_screen_documents(spark, sf_dir):
    return _screened(texts(spark, sf_dir, "documents"), "doc_id", "text")


@query("input_screen_chat", _screen_sql(CHAT, "message_id", "content"))
def input_screen_chat(spark, sf_dir):
    return _screened(derive(spark, sf_dir, "chat"), "message_id", "content")


@query("input_risk", f"SELECT doc_id, round({_risk_sql('text')}, 6) AS risk_score FROM documents")
def input_risk(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.round(R.risk_score(F.col("text")), 6).alias("risk_score"))


@query(
    "input_sanitize",
    f"""
    SELECT doc_id, {TRIM.format("regexp_replace(regexp_replace(regexp_replace(substr(t, 1, 10000), '\\n{3,}', chr(10) || chr(10), 'g'), ' {3,}', '  ', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{Cf}\\p{Co}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')")} AS clean
    FROM (SELECT doc_id, replace(replace(text, '. ', '.' || chr(9) || '   ' || chr(7)), ',', chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents)
    """,
)
def input_sanitize(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "replace(replace(text, '. ', '.' || chr(9) || '   ' || chr(7)), ',', chr(10) || chr(10) || chr(10) || chr(10)) AS t",
    )
    return docs.select("doc_id", R.sanitize(F.col("t")).alias("clean"))


@query(
    "request_limits",
    f"""
    SELECT count(*) FILTER (WHERE length(content) BETWEEN 1 AND 4000) AS good_messages,
           count(*) FILTER (WHERE NOT (length(content) BETWEEN 1 AND 4000)) AS bad_messages
    FROM (SELECT content FROM {CHAT} UNION ALL SELECT text FROM documents)
    """,
)
def request_limits(spark, sf_dir):
    messages = derive(spark, sf_dir, "chat").select("content").unionAll(texts(spark, sf_dir, "documents").select("text"))
    ok = R.is_acceptable_request(F.col("content"))
    return messages.agg(F.count_if(ok).alias("good_messages"), F.count_if(~ok).alias("bad_messages"))


# --- pattern tables ---------------------------------------------------------
#: up to ten patterns of two neighbouring words from each document
_PAIRS_SQL = f"""
    SELECT DISTINCT ws[k] AS a, ws[k + 1] AS b
    FROM (SELECT {tokens_sql("lower(text)")} AS ws FROM documents), (SELECT unnest([1, 10, 19, 28, 37, 46, 55, 64, 73, 82]) AS k)
    WHERE regexp_matches(ws[k], '^[a-z]+$') AND regexp_matches(ws[k + 1], '^[a-z]+$')"""


@query(
    "pattern_table",
    f"""
    WITH pairs AS ({_PAIRS_SQL}),
    words AS (SELECT doc_id, {tokens_sql("lower(text)")} AS ws FROM documents),
    grams AS (SELECT doc_id, unnest(list_zip(ws[:-2], ws[2:])) AS g FROM words WHERE len(ws) > 1),
    hits AS (SELECT g[1] AS a, g[2] AS b, doc_id FROM grams)
    SELECT '(?<!\\S)' || a || '\\s+' || b || '(?!\\S)' AS pattern, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc
    FROM hits SEMI JOIN pairs USING (a, b) GROUP BY a, b
    """,
)
def pattern_table(spark, sf_dir):
    """A pattern table of thousands of rows, taken from the documents, against every whole document."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    words = docs.select(T.tokens(F.lower("text")).alias("ws"))
    pairs = words.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(81), F.lit(9)), lambda k: F.struct(F.get("ws", k).alias("a"), F.get("ws", k + 1).alias("b")))).alias("p")
    ).select("p.*").where(F.col("a").rlike("^[a-z]+$") & F.col("b").rlike("^[a-z]+$")).distinct()
    pattern = F.concat(F.lit(r"(?<!\S)"), "a", F.lit(r"\s+"), "b", F.lit(r"(?!\S)"))
    patterns = pairs.select(pattern.alias("pattern_id"), pattern.alias("pattern"))
    hits = P.matching_patterns(docs, ["doc_id"], "text", patterns)
    return hits.groupBy(F.col("pattern_id").alias("pattern")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("input_screen_table", _screen_sql(CHAT, "message_id", "content"))
def input_screen_table(spark, sf_dir):
    """Chat messages screened with the patterns as a table."""
    listed = [(p, "injection") for p in R.INJECTION_PATTERNS] + [(p, "blocked") for p in R.BLOCKED_PATTERNS]
    patterns = spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(listed)], "pattern_id int, pattern string, kind string")
    screened = P.screen_by_table(derive(spark, sf_dir, "chat"), "message_id", "content", patterns)
    return screened.withColumn("risk_score", F.round("risk_score", 6))


# --- redaction --------------------------------------------------------------
_STAGES = [(n, p, R.PII_REPLACEMENTS[n]) for n, p in R.PII_PATTERNS.items()] + [
    ("credential", "(?i)" + p, R.CREDENTIAL_REPLACEMENT) for p in R.CREDENTIAL_PATTERNS
]


def _redact_sql(source: str, key: str, t: str) -> str:
    """One sub-query per stage, each counting on the text the last one left."""
    sql = f"(SELECT {key}, coalesce({t}, '') AS t FROM {source})"
    for i, (_, pattern, marker) in enumerate(_STAGES):
        sql = (
            f"(SELECT * EXCLUDE (t), len(regexp_extract_all(t, {lit(pattern)})) AS n{i}, "
            f"regexp_replace(t, {lit(pattern)}, {lit(marker)}, 'g') AS t FROM {sql})"
        )
    total = " + ".join(f"n{i}" for i in range(len(_STAGES)))
    pii = [f"CASE WHEN n{i} > 0 THEN '{n}' END" for i, (n, _, _) in enumerate(_STAGES) if n != "credential"]
    creds = " + ".join(f"n{i}" for i, (n, _, _) in enumerate(_STAGES) if n == "credential")
    kinds = ", ".join([*pii, f"CASE WHEN {creds} > 0 THEN 'credential' END"])
    return f"SELECT {key}, t AS redacted, {total} AS pii_removed, concat_ws(',', {kinds}) AS filtered_types FROM {sql}"


def _redacted(df, key, text):
    out = df.select(key, R.redact_output(F.col(text)).alias("r"))
    return out.select(
        key, F.col("r.text").alias("redacted"), "r.pii_removed", F.array_join("r.filtered_types", ",").alias("filtered_types")
    )


@query("pii_redact_documents", _redact_sql("documents", "doc_id", "text"), ints=("pii_removed",))
def pii_redact_documents(spark, sf_dir):
    return _redacted(texts(spark, sf_dir, "documents"), "doc_id", "text")


@query("pii_redact_chat", _redact_sql(CHAT, "message_id", "content"), ints=("pii_removed",))
def pii_redact_chat(spark, sf_dir):
    return _redacted(derive(spark, sf_dir, "chat"), "message_id", "content")


@query(
    "pii_totals_by_source",
    "SELECT source, type, CAST(sum(n) AS BIGINT) AS found FROM ("
    + " UNION ALL ".join(
        f"SELECT source, '{n}' AS type, len(regexp_extract_all(text, {lit(p)})) AS n FROM documents"
        for n, p in R.PII_PATTERNS.items()
    )
    + ") WHERE n > 0 GROUP BY 1, 2",
)
def pii_totals_by_source(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    return (
        docs.select("source", F.explode(R.pii_counts(F.col("text"))).alias("type", "n"))
        .groupBy("source", "type")
        .agg(F.sum("n").alias("found"))
    )


def _pii_only_sql(t: str, extra: list[tuple[str, str]] = ()) -> str:
    for n, p in [*R.PII_PATTERNS.items(), *extra]:
        t = f"regexp_replace({t}, {lit(p)}, {lit(R.replacement_for(n))}, 'g')"
    return t


@query(
    "redact_sources",
    f"""
    SELECT message_id, {_pii_only_sql("content", [("badge", "INC[0-9]+")])} AS first_source,
           {_pii_only_sql("'mail user' || CAST(session_id AS VARCHAR) || '@example.org about password: x'", [("badge", "INC[0-9]+")])} AS second_source
    FROM {CHAT}
    """,
)
def redact_sources(spark, sf_dir):
    chat = derive(spark, sf_dir, "chat").select(
        "message_id",
        F.array("content", F.expr("'mail user' || CAST(session_id AS STRING) || '@example.org about password: x'")).alias("sources"),
    )
    clean = R.redact_sources(F.col("sources"), {"badge": "INC[0-9]+"})
    return chat.withColumn("clean", clean).select(
        "message_id", F.get("clean", 0).alias("first_source"), F.get("clean", 1).alias("second_source")
    )


# --- files ------------------------------------------------------------------
_RULE = "'" + S.CSV_RULE + "'"
_NL = "chr(10)"


#: documents a written file holds at most (of neighbouring ids)
FILE_DOCS = 400
#: files of one format that a task writes, about, and documents; small tables are spread over the cores down to the least
FILES_A_TASK, DOCS_A_TASK, LEAST_FILES = 512, 10_000, 64


def _load_sql() -> str:
    by_part = f"FROM (SELECT *, doc_id // {FILE_DOCS} AS part FROM documents) GROUP BY source, part"
    csv_rows = f"string_agg(doc_id || ' | ' || lang || ' | ' || n_chars, {_NL} ORDER BY doc_id)"
    xml_rows = (
        f"string_agg('    <doc>' || {_NL} || '        <doc_id>' || doc_id || '</doc_id>' || {_NL} || '        <lang>' || lang || '</lang>' || {_NL} || '    </doc>' || {_NL}, '' ORDER BY doc_id)"
    )
    return f"""
    SELECT source, part, 'txt' AS document_type, string_agg(text || {_NL}, '' ORDER BY doc_id) AS content, CAST(sum(1 + len(string_split(text, {_NL}))) - count(*) + 1 AS VARCHAR) AS detail {by_part}
    UNION ALL SELECT source, part, 'csv', 'doc_id | lang | n_chars' || {_NL} || {_RULE} || {_NL} || {csv_rows}, CAST(count(*) AS VARCHAR) {by_part}
    UNION ALL SELECT source, part, 'json', '{{' || {_NL} || '  "documents": ' || count(*) || ',' || {_NL} || '  "first": ' || min(doc_id) || {_NL} || '}}', '["documents", "first"]' {by_part}
    UNION ALL SELECT source, part, 'xml', '<docs>' || {_NL} || {xml_rows} || '</docs>', 'docs' {by_part}
    """


def _write_files(docs, root, cut):
    """By the tasks themselves, each row as Spark's writers of the formats write it."""

    def lines(rows, line, *order):
        return rows.select(*L.group_names(*cut), *order, line.alias("__line")).sortWithinPartitions(*cut, *order).select(*cut, "__line")

    def ended(text):
        return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))

    row = ["doc_id", "lang", "n_chars"]
    counted = docs.groupBy(*cut).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    # a row between the root's tags, which are left out again
    xml = F.to_xml(F.struct(F.struct("doc_id", "lang").alias("doc")), {"rowTag": "docs"})
    head, tail = "<docs>\n", "</docs>"
    row_xml = F.substring(xml, F.lit(len(head) + 1), F.length(xml) - len(head) - len(tail))
    L.write_groups(lines(docs, ended(F.col("text")), "doc_id"), f"{root}/txt", ".txt")
    L.write_groups(lines(docs, ended(F.to_csv(F.struct(*row))), "doc_id"), f"{root}/csv", ".csv", head=",".join(row) + "\n")
    L.write_groups(lines(counted, ended(F.to_json(F.struct("documents", "first")))), f"{root}/json", ".json")
    L.write_groups(lines(docs, row_xml, "doc_id"), f"{root}/xml", ".xml", head, tail)


def _write_files_elsewhere(docs, path, cut):
    """By Spark's writers."""
    docs = docs.sortWithinPartitions(*cut, "doc_id")

    def written(rows):
        # tasks put their files in place themselves; the folder is new and read only when all have
        return rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*cut)

    written(docs.select(*cut, "text")).text(f"{path}/txt")
    written(docs.select(*cut, "doc_id", "lang", "n_chars")).csv(f"{path}/csv", header=True)
    counted = docs.groupBy(*cut).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    written(counted).json(f"{path}/json")
    written(docs.select(*cut, "doc_id", "lang")).xml(f"{path}/xml", rowTag="doc", rootTag="docs", declaration="")


@query("load_written_files", _load_sql())
def load_written_files(spark, sf_dir):
    """Text, CSV, JSON and XML files of at most 400 documents, written to the shared folder and loaded; a file that cannot be loaded comes out with its reason.

    A source of any size is many files, written by many tasks: as many as the
    number of files and of documents asks for, as narrow rows are as many files
    as wide ones.  Folders of parts hold those of their sources, so a listing
    spreads over the parts, and all scans share it.
    """
    cut = ["part", "source"]
    docs = table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / FILE_DOCS))
    told = docs.groupBy(*cut).count().agg(F.count("*").alias("files"), F.coalesce(F.sum("count"), F.lit(0)).alias("docs")).first()
    spread = min(spark.sparkContext.defaultParallelism, -(-told["files"] // LEAST_FILES))
    writers = max(1, spread, -(-told["files"] // FILES_A_TASK), -(-told["docs"] // DOCS_A_TASK))
    path = scratch_dir(spark, "files")
    root = L.local_path(spark, path)
    if root is not None:
        _write_files(docs.repartition(writers, *cut), root, cut)
    else:
        _write_files_elsewhere(docs.repartition(writers, *cut), path, cut)
    listed = S.list_files(spark, path)
    known = F.coalesce(*[F.try_element_at("metadata", F.lit(n)) for n in ("line_count", "row_count", "top_level_keys", "root_tag")])
    read = S.read_files(spark, path, files=listed)
    kind = F.when(F.col("reason").isNull(), S.document_type(F.col("source_path"))).otherwise("rejected")
    loaded = read.select("source_path", kind.alias("document_type"), "content", F.coalesce("reason", known).alias("detail"))
    rejected = S.rejected_files(spark, path, files=listed)
    rejected = rejected.select("source_path", F.lit("rejected").alias("document_type"), F.lit(None).cast("string").alias("content"), F.col("reason").alias("detail"))
    return loaded.unionByName(rejected).select(
        F.regexp_extract("source_path", "source=([^/]+)/", 1).alias("source"),
        F.regexp_extract("source_path", "part=([^/]+)/", 1).try_cast("long").alias("part"),
        "document_type",
        "content",
        "detail",
    )


# --- claims and grounding ---------------------------------------------------
def _term_claims_sql(t: str) -> str:
    hedged = " OR ".join(f"contains(lower(s), '{h}')" for h in C.HEDGES)
    definite = " OR ".join(f"contains(lower(s), '{w}')" for w in C.DEFINITIVE_WORDS)
    split = f"list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: {TRIM.format('s')})"
    return f"list_filter({split}, lambda s: length(s) >= 10 AND NOT ({hedged}) AND (regexp_matches(s, '\\p{{Nd}}') OR {definite}))"


def _overlap_claims_sql(t: str) -> str:
    known = " OR ".join(f"contains(lower(s), '{w}')" for w in [*C.STATUS_WORDS, *C.CONFIG_WORDS])
    split = f"list_transform(string_split({t}, '.'), lambda s: {TRIM.format('s')})"
    return f"list_distinct(list_filter({split}, lambda s: length(s) > 0 AND (regexp_matches(s, '{C.DIGIT}') OR {known})))"


_STOP_A = "[" + sql_list(C.TERM_STOP_WORDS) + "]"
_STOP_B = "[" + sql_list(C.OVERLAP_STOP_WORDS) + "]"


def _terms_sql(t: str) -> str:
    words = f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_filter({words}, lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains({_STOP_A}, w))[1:10]"


@query(
    "claims_terms",
    f"""
    SELECT doc_id, claim, array_to_string({_terms_sql("lower(claim)")}, ' ') AS key_terms
    FROM (SELECT doc_id, unnest({_term_claims_sql("text")}) AS claim FROM documents)
    """,
)
def claims_terms(spark, sf_dir):
    rows = G.term_claim_rows(texts(spark, sf_dir, "documents"), "text", ["doc_id"])
    return rows.select("doc_id", "claim", F.array_join(C.key_terms(F.lower("claim")), " ").alias("key_terms"))


@query("claims_overlap", f"SELECT doc_id, unnest({_overlap_claims_sql('text')}) AS claim FROM documents")
def claims_overlap(spark, sf_dir):
    return G.overlap_claim_rows(texts(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "claim")


def _with_evidence(spark, sf_dir):
    """Each chat message with the six before it in its session as evidence."""
    chat = derive(spark, sf_dir, "chat")
    return lookback(chat, ["session_id"], "ts", F.col("content"), 6, "evidence")


_EVIDENCE_SQL = f"""(SELECT *, list(content) OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS evidence FROM {CHAT})"""


@query(
    "grounding_terms",
    f"""
    WITH base AS (SELECT message_id, content, evidence, lower(array_to_string(evidence, ' ')) AS ctx FROM {_EVIDENCE_SQL}),
    claims AS (SELECT message_id, ctx, unnest({_term_claims_sql("content")}) AS claim FROM base WHERE len(evidence) > 0),
    parts AS (SELECT message_id, ctx, claim, {_terms_sql("lower(claim)")} AS terms,
              list_distinct(regexp_extract_all(claim, '{C.NUMBER}')) AS nums,
              regexp_extract_all(ctx, '{C.NUMBER}') AS ctx_nums FROM claims),
    scored AS (SELECT message_id, len(terms) = 0 OR
               len(list_filter(terms, lambda t: contains(ctx, t)))::DOUBLE / len(terms) * 0.7::DOUBLE
               + CASE WHEN len(list_filter(nums, lambda n: NOT list_contains(ctx_nums, n))) = 0 THEN 0.3::DOUBLE ELSE 0 END >= 0.7::DOUBLE AS grounded
               FROM parts),
    counts AS (SELECT message_id, count(*) AS n, count(*) FILTER (WHERE grounded) AS g FROM scored GROUP BY 1)
    SELECT b.message_id, coalesce(g, 0) AS grounded_count, coalesce(n, 0) - coalesce(g, 0) AS ungrounded_count,
           CASE WHEN len(b.evidence) IS NULL OR len(b.evidence) = 0 THEN 0 WHEN n IS NULL THEN 1 ELSE g::DOUBLE / n END AS confidence_score,
           CASE WHEN len(b.evidence) IS NULL OR len(b.evidence) = 0 THEN false WHEN n IS NULL THEN true ELSE g::DOUBLE / n >= 0.8::DOUBLE END AS is_grounded
    FROM base b LEFT JOIN counts USING (message_id)
    """,
    ints=("grounded_count", "ungrounded_count"),
)
def grounding_terms(spark, sf_dir):
    out = G.check_terms(_with_evidence(spark, sf_dir), "content", "evidence")
    return out.select("message_id", "grounded_count", "ungrounded_count", "confidence_score", "is_grounded")


def _overlap_verdict_sql(evidence_rows: str, responses: str) -> str:
    """Claims against evidence rows, stated as a theta join."""
    keywords = f"list_filter(list_distinct({tokens_sql('lower(claim)')}), lambda w: NOT list_contains({_STOP_B}, w))"
    return f"""
    WITH responses AS ({responses}), evidence AS ({evidence_rows}),
    claims AS (SELECT message_id, unnest({_overlap_claims_sql("content")}) AS claim FROM responses),
    words AS (SELECT message_id, claim, {keywords} AS kw FROM claims),
    toks AS (SELECT message_id, list_distinct({tokens_sql("lower(evidence)")}) AS toks FROM evidence),
    judged AS (SELECT w.message_id, w.claim,
               len(any_value(w.kw)) = 0 OR coalesce(max(len(list_intersect(w.kw, t.toks))::DOUBLE / greatest(len(w.kw), 1)), 0) >= 0.5 AS ok
               FROM words w LEFT JOIN toks t USING (message_id) GROUP BY w.message_id, w.claim),
    counts AS (SELECT message_id, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM judged GROUP BY 1)
    SELECT message_id, coalesce(n, 0) AS claim_count, score AS grounding_score, score >= 0.7::DOUBLE AS is_grounded,
      CASE WHEN n IS NULL THEN 'No factual claims detected'
           WHEN score >= 0.9 THEN 'Response well-grounded in sources. Safe to present.'
           WHEN score >= 0.7 THEN 'Response mostly grounded. ' || CAST(bad AS VARCHAR) || ' claim(s) lack direct source support. Consider adding caveats.'
           WHEN score >= 0.4 THEN 'Response partially grounded. Recommend human review before presenting to user. Ungrounded claims should be removed or flagged as uncertain.'
           ELSE 'Response poorly grounded. Recommend escalation to human operator. Do not present as authoritative.' END AS recommendation
    FROM (SELECT r.message_id, n, bad, coalesce((n - bad)::DOUBLE / n, 1) AS score FROM responses r LEFT JOIN counts USING (message_id))
    """


@query(
    "grounding_overlap",
    _overlap_verdict_sql(
        f"SELECT message_id, unnest(evidence) AS evidence FROM {_EVIDENCE_SQL}", f"SELECT message_id, content FROM {CHAT}"
    ),
    ints=("claim_count",),
)
def grounding_overlap(spark, sf_dir):
    out = G.check_overlap(_with_evidence(spark, sf_dir), "content", "evidence")
    return out.select("message_id", "claim_count", "grounding_score", "is_grounded", "recommendation")


_DOC_EVIDENCE = f"SELECT message_id, content AS evidence FROM {CHAT} WHERE message_id % 2 = 1 UNION ALL SELECT event_id - event_id % 2, 'value ' || props || ' compliant below' FROM events"


@query("grounding_evidence_rows", _overlap_verdict_sql(_DOC_EVIDENCE.replace("SELECT message_id, content", "SELECT message_id - 1 AS message_id, content", 1), f"SELECT message_id, content FROM {CHAT}"), ints=("claim_count",))
def grounding_evidence_rows(spark, sf_dir):
    """Each even message is checked against the next message and two tool results."""
    chat = derive(spark, sf_dir, "chat")
    documents = chat.where("message_id % 2 = 1").selectExpr("message_id - 1 AS message_id", "content")
    tools = table(spark, sf_dir, "events").selectExpr(
        "event_id - event_id % 2 AS message_id", "'value ' || props || ' compliant below' AS result"
    )
    evidence = G.evidence_rows(documents, tools, "message_id")
    return G.check_overlap_rows(chat, evidence, "message_id", "content")


# --- chunks -----------------------------------------------------------------
_SECTIONED = "replace(text, chr(10), chr(10) || 'Section ' || CAST(doc_id % 40 AS {s}) || ': scope of work' || chr(10))"


_SECTIONS_SQL = f"""
    WITH marked AS (SELECT doc_id, string_split(regexp_replace(t, '(?im)(?:^|\\n)(?:Article|Section|Clause)\\s+\\d+[:\\.\\s][^\\n]+', '@@@@\\0####', 'g'), '@@@@') AS parts
                    FROM (SELECT doc_id, {_SECTIONED.format(s="VARCHAR")} AS t FROM documents)),
    pieces AS (SELECT doc_id, len(parts) AS n, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM marked),
    sections AS (
      SELECT doc_id, i, CAST(NULL AS VARCHAR) AS title, part AS body FROM pieces WHERE n = 1
      UNION ALL SELECT doc_id, i, NULL, {TRIM.format("part")} FROM pieces WHERE n > 1 AND i = 1 AND length(part) > 200
      UNION ALL SELECT doc_id, i, {TRIM.format("split_part(part, '####', 1)")}, {TRIM.format("split_part(part, '####', 2)")} FROM pieces WHERE i > 1)"""


@query("chunk_sections", _SECTIONS_SQL + " SELECT doc_id, title, body FROM sections WHERE length(body) > 0")
def chunk_sections(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.expr(_SECTIONED.format(s="STRING")).alias("t"))
    return docs.select("doc_id", F.inline(K.split_sections(F.col("t"))))


@query(
    "chunk_config_blocks",
    f"""
    WITH parts AS (SELECT config_id, list_transform(string_split(config, chr(10) || '!'), lambda p: {TRIM.format("p")}) AS ps FROM {derived_sql("configs")}),
    blocks AS (SELECT config_id, list_concat(list_filter(ps, lambda p: starts_with(p, 'interface')), list_filter(ps, lambda p: starts_with(p, 'router'))) AS bs FROM parts)
    SELECT config_id, generate_subscripts(bs, 1) - 1 AS chunk_index, unnest(bs) AS content,
           CASE WHEN starts_with(unnest(bs), 'interface') THEN 'interface' ELSE 'routing' END AS config_block_type
    FROM blocks
    """,
    ints=("chunk_index",),
)
def chunk_config_blocks(spark, sf_dir):
    configs = derive(spark, sf_dir, "configs").select(
        F.col("config_id"), F.col("config_id").cast("string").alias("doc_id"), F.col("config").alias("content"),
        F.lit("config").alias("document_type"),
    )
    return K.chunk_documents(configs, keep=["config_id"]).select("config_id", "chunk_index", "content", "config_block_type")


def _pack_sql(items: str, limit: int, extra: int, joiner: str, carry: bool) -> str:
    """Greedy packing as a list reduction: every item starts as a pack of its own."""
    start = f"list_transform({items}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'open': [s], 'n': length(s) + {extra}}})"
    kept = "[acc.open[-1]]" if carry else "CAST([] AS VARCHAR[])"
    kept_n = "length(acc.open[-1])" if carry else "0"
    step = (
        f"lambda acc, x: CASE WHEN acc.n + x.n > {limit} THEN {{'done': list_append(acc.done, array_to_string(acc.open, {joiner})), "
        f"'open': list_concat({kept}, x.open), 'n': {kept_n} + x.n}} "
        f"ELSE {{'done': acc.done, 'open': list_concat(acc.open, x.open), 'n': acc.n + x.n}} END"
    )
    return f"list_transform([list_reduce({start}, {step})], lambda r: list_append(r.done, array_to_string(r.open, {joiner})))[1]"


_SENTENCES = "string_split(regexp_replace(body, '([.!?])\\s+', '\\1@@@@', 'g'), '@@@@')"


@query(
    "chunk_semantic_sections",
    f"""
    {_SECTIONS_SQL},
    packed AS (SELECT doc_id, i, title AS section_header, CASE WHEN length(body) > 2000 THEN {_pack_sql(_SENTENCES, 2000, 0, "' '", True)}
               WHEN length(body) >= 200 THEN [body] ELSE [] END AS chunks FROM sections WHERE length(body) > 0),
    flat AS (SELECT doc_id, section_header, i, generate_subscripts(chunks, 1) AS j, unnest(chunks) AS content FROM packed)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, section_header, content FROM flat
    """,
    ints=("chunk_index",),
)
def chunk_semantic_sections(spark, sf_dir):
    """Section chunks with sentence packing, before any fall-back to the splitter."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.expr(_SECTIONED.format(s="STRING")).alias("t"))
    rows = explode_rows(docs, ["doc_id"], K.semantic_chunks(K.split_sections(F.col("t"))), "chunk_index", "c")
    return rows.select("doc_id", "chunk_index", "c.section_header", "c.content")


def _splitter_sql(source: str, size: int, overlap: int, separators: list[str]) -> str:
    """The recursive splitter as a work list: one step takes the first piece of a document's list.

    A short piece joins the open window; a long one closes it and is replaced
    by its parts at the next finer separator, with a closing mark (null) behind.
    """
    none = len(separators)
    marks = [lit(m).replace("\n", "' || chr(10) || '") for m in separators]

    def parts(t: str, mark: str, level: int) -> str:
        pieces = f"list_transform(string_split({t}, {mark}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {mark} || x END)"
        return f"list_transform(list_filter({pieces}, lambda x: x <> ''), lambda x: {{'t': x, 'lv': {level}}})"

    def expanded(t: str, lv: str) -> str:
        cases = " ".join(f"WHEN {lv} <= {i} AND contains({t}, {m}) THEN {parts(t, m, i + 1)}" for i, m in enumerate(marks))
        return f"list_concat(CASE {cases} ELSE [{{'t': {t}, 'lv': {none}}}] END, [{{'t': CAST(NULL AS VARCHAR), 'lv': 0}}])"

    def held(items: str) -> str:
        return f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"

    closed = f"list_filter([{TRIM.format("array_to_string(win, '')")}], lambda x: x <> '')"
    nothing = "CAST([] AS VARCHAR[])"
    room = f"list_filter(range(0, len(win) + 1), lambda k: {held('win[k + 1:]')} <= {overlap} AND {held('win[k + 1:]')} + length(t) <= {size})[1]"
    return f"""
    WITH RECURSIVE steps AS (
      SELECT doc_id, CASE WHEN text = '' THEN [] ELSE {expanded("text", "0")} END AS todo, {nothing} AS win, {nothing} AS done FROM {source}
      UNION ALL
      SELECT doc_id,
        CASE WHEN t IS NULL OR length(t) < {size} OR lv >= {none} THEN rest ELSE list_concat({expanded("t", "lv")}, rest) END,
        CASE WHEN t IS NULL OR length(t) >= {size} THEN {nothing} WHEN full_ THEN list_append(win[{room} + 1:], t) ELSE list_append(win, t) END,
        CASE WHEN t IS NOT NULL AND length(t) < {size} AND NOT full_ THEN done
          ELSE list_concat(done, {closed}, CASE WHEN length(t) >= {size} AND lv >= {none} THEN [t] ELSE {nothing} END) END
      FROM (SELECT *, len(win) > 0 AND {held('win')} + length(t) > {size} AS full_
            FROM (SELECT doc_id, todo[1].t AS t, todo[1].lv AS lv, todo[2:] AS rest, win, done FROM steps WHERE len(todo) > 0)))
    SELECT doc_id, generate_subscripts(done, 1) - 1 AS chunk_index, unnest(done) AS content FROM steps WHERE len(todo) = 0
    """


_SPLITS = {"prose": (300, 60), "markdown": (1000, 100), "network_config": (500, 100)}
_SPLITTABLE = "(SELECT doc_id, replace(text, '. ', CASE WHEN doc_id % 5 = 0 THEN chr(10) || '---' || chr(10) ELSE '. ' END) AS text FROM documents)"


@query(
    "split_recursive",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, * FROM ({_splitter_sql(_SPLITTABLE, size, overlap, K._SEPARATORS[kind])})"
        for kind, (size, overlap) in _SPLITS.items()
    ),
    ints=("chunk_index",),
)
def split_recursive(spark, sf_dir):
    """Every document through the recursive splitter with each of its three separator lists."""
    docs = texts(spark, sf_dir, "documents").selectExpr(
        "doc_id", "replace(text, '. ', CASE WHEN doc_id % 5 = 0 THEN chr(10) || '---' || chr(10) ELSE '. ' END) AS text"
    )
    parts = [
        docs.select("doc_id", K.split_texts(F.col("text"), size, overlap, kind).alias("c")).select(
            F.lit(kind).alias("kind"), "doc_id", F.posexplode("c").alias("chunk_index", "content")
        )
        for kind, (size, overlap) in _SPLITS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ALL_SECTIONS = "(?im)(?:^|\\n)(?:" + "|".join(p.removeprefix("(?:^|\\n)") for p in K.SECTION_PATTERNS) + ")"
_PLANS: dict[tuple[str, int, int], list[str]] = {}
for _kind, _plan in K.CHUNK_PLAN.items():
    if _kind != "sla":
        _PLANS.setdefault(_plan, []).append(_kind)


def _chunks_sql(docs: str) -> str:
    """Chunks of documents (doc_id, text, document_type) by the strategy of each type, stated per strategy.

    No test document holds a device block, so those of type ``config`` are all
    split as text here; ``chunk_config_blocks`` states the blocks.
    """
    none = "CAST(NULL AS VARCHAR)"
    first_line = TRIM.format("lower(split_part(content, chr(10), 1))")
    block = "CASE " + " ".join(f"WHEN starts_with({first_line}, '{p}') THEN '{n}'" for p, n in K.BLOCK_TYPES) + f" ELSE '{K.OTHER_BLOCK_TYPE}' END"
    header = f"nullif({TRIM.format("regexp_extract(content, '(?m)^#{1,6}[ ]+(.+)$', 1)".replace('[ ]', chr(92) + 's'))}, '')"

    def split(where: str, strategy: str, size: int, overlap: int) -> str:
        chunks = _splitter_sql(f"(SELECT doc_id, text FROM docs WHERE {where})", size, overlap, K._SEPARATORS[strategy])
        labels = f"{header if strategy == 'markdown' else none}, {block if strategy == 'network_config' else none}, '{strategy}'"
        return f"SELECT doc_id, chunk_index, content, {labels} FROM ({chunks})"

    plain = [split(f"document_type IN ({sql_list(kinds)})", *plan) for plan, kinds in _PLANS.items()]
    untitled = split("document_type = 'sla' AND doc_id NOT IN (SELECT doc_id FROM semantic)", "prose", 1000, 200)
    return f"""
    WITH docs AS ({docs}),
    marked AS (SELECT doc_id, string_split(regexp_replace(text, {lit(_ALL_SECTIONS)}, '@@@@\\0####', 'g'), '@@@@') AS parts FROM docs WHERE document_type = 'sla'),
    pieces AS (SELECT doc_id, len(parts) AS n, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM marked),
    sections AS (
      SELECT doc_id, i, {none} AS title, part AS body FROM pieces WHERE n = 1
      UNION ALL SELECT doc_id, i, NULL, {TRIM.format("part")} FROM pieces WHERE n > 1 AND i = 1 AND length(part) > {K.MIN_SECTION}
      UNION ALL SELECT doc_id, i, {TRIM.format("split_part(part, '####', 1)")}, {TRIM.format("split_part(part, '####', 2)")} FROM pieces WHERE i > 1),
    packed AS (SELECT doc_id, i, nullif(title, '') AS title, CASE WHEN length(body) > {K.MAX_SECTION} THEN {_pack_sql(_SENTENCES, K.MAX_SECTION, 0, "' '", True)}
               WHEN length(body) >= {K.MIN_SECTION} THEN [body] ELSE [] END AS chunks FROM sections WHERE length(body) > 0),
    flat AS (SELECT doc_id, title, i, generate_subscripts(chunks, 1) AS j, unnest(chunks) AS content FROM packed),
    semantic AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, content, title FROM flat),
    chunks(document_id, chunk_index, content, section_header, config_block_type, chunk_strategy) AS (
      SELECT doc_id, chunk_index, content, title, {none}, 'semantic' FROM semantic
      UNION ALL {" UNION ALL ".join([*plain, untitled])})
    SELECT document_id || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, * FROM chunks
    """


@query(
    "chunk_documents",
    _chunks_sql(
        f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, content AS text, document_type FROM ({_TYPED_SQL}) JOIN {FILES} USING (doc_id) WHERE document_type IS NOT NULL"
    ),
    ints=("chunk_index",),
)
def chunk_documents(spark, sf_dir):
    """Whole corpus through the strategy of each document's type."""
    files = derive(spark, sf_dir, "files").withColumn("document_type", S.document_type(F.col("source_path")))
    docs = files.where(F.col("document_type").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), "content", "document_type"
    )
    return K.chunk_documents(docs)


@query(
    "chunk_semantic",
    _chunks_sql(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_SECTIONED.format(s='VARCHAR')} AS text, 'sla' AS document_type FROM documents"),
    ints=("chunk_index",),
)
def chunk_semantic(spark, sf_dir):
    """Section chunks with the fall-back, as documents of type ``sla`` are chunked."""
    docs = texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.expr(_SECTIONED.format(s="STRING")).alias("content"),
        F.lit("sla").alias("document_type"),
    )
    return K.chunk_documents(docs)


_STREAMED = [("prose", 400, 80), ("markdown", 700, 70), ("network_config", 500, 100)]


@query(
    "chunk_stream",
    " UNION ALL ".join(
        f"SELECT * FROM ({_splitter_sql(f'(SELECT doc_id, text FROM documents WHERE doc_id % 3 = {i})', size, overlap, K._SEPARATORS[kind])})"
        for i, (kind, size, overlap) in enumerate(_STREAMED)
    ),
    ints=("chunk_index",),
)
def chunk_stream(spark, sf_dir):
    """Every document through the streaming splitter, by sizes and separators of its row."""
    plans = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("size"), F.lit(o).alias("overlap")) for k, n, o in _STREAMED])
    plan = F.get(plans, (F.col("doc_id") % 3).cast("int"))
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", plan.alias("p")).select("doc_id", "text", "p.*")
    return K.stream_chunks(docs, ["doc_id"], "text", "size", "overlap", "kind")


@query(
    "pack_lines",
    f"""
    SELECT doc_id, generate_subscripts(ps, 1) - 1 AS chunk_index, unnest(ps) AS content
    FROM (SELECT doc_id, {_pack_sql("string_split(text, chr(10))", 500, 1, "chr(10)", False)} AS ps FROM documents)
    """,
    ints=("chunk_index",),
)
def pack_lines(spark, sf_dir):
    """Line-bounded packing of whole documents."""
    docs = texts(spark, sf_dir, "documents")
    return explode_rows(docs, ["doc_id"], K.pack_lines(F.col("text"), 500), "chunk_index", "content")


@query(
    "markdown_headers",
    f"""
    SELECT doc_id, nullif({TRIM.format("regexp_extract(t, '(?m)^#{1,6}\\s+(.+)$', 1)")}, '') AS section_header
    FROM (SELECT doc_id, 'intro' || chr(10) || repeat('#', CAST(doc_id % 8 AS BIGINT)) || ' Head ' || source || chr(10) || text AS t FROM documents)
    """,
)
def markdown_headers(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'intro' || chr(10) || repeat('#', CAST(doc_id % 8 AS INT)) || ' Head ' || source || chr(10) || text AS t"
    )
    return docs.select("doc_id", K.section_header(F.col("t")).alias("section_header"))
