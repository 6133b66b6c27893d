"""One query for each operator, over its whole table, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.llm import ann, exact_topk, hilbert, langid, licenses, lines, mixing, packing, periodic, repair, rollups, simhash, trie
from opsloom.llm.shared import word_count
from opsloom.operators.skew import lookup
from opsloom.session import cut_lineage, scratch_dir, widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: \x20\x09-\x0D as DuckDB spells it
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUN = r"'[\x20\x09-\x0D]+'"


def _fold(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"CASE WHEN trim(coalesce({text}, ''), {_BLANKS}) = '' THEN 0 ELSE len(string_split_regex(trim({text}, {_BLANKS}), {_RUN})) END"


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_adaptive_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@_query(
    "op2_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    k AS (SELECT *, {_fold(f"trim(line, {_BLANKS})")} AS key FROM x),
    c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> c.keep, false) AS gone FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.kept_lines(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


_PIECES = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]"
_FIRST_CUT = r"^[^\n]*\n?"


def _rolled_up(spark: SparkSession, counted: DataFrame, first: str, second: str) -> DataFrame:
    """Four batches: ``tokens`` by a first version, ``others`` by a second, revised to ``fewer``, exact copies deleted; one batch is sent twice."""
    path = scratch_dir(spark, "token-rollup")
    rollups.commit(path, "load", rollups.inserted(counted, first, F.col("tokens")))
    rollups.commit(path, "second-version", rollups.inserted(counted, second, F.col("others")))
    rollups.commit(path, "revision", rollups.revised(counted, first, F.col("tokens"), F.col("fewer")))
    # a text that a third of all documents repeat is looked up, not sent to one task
    firsts = cut_lineage(counted.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "firsts")
    copies = cut_lineage(lookup(counted, firsts, "digest", ["first_id"]).where(F.col("doc_id") != F.col("first_id")), "copies")
    gone = rollups.deleted(copies, first, F.col("fewer")).unionByName(rollups.deleted(copies, second, F.col("others")))
    for _ in range(2):
        rollups.commit(path, "copies", gone)
    return rollups.totals(spark, path)


def _revisable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their text, the text without its first line, and a digest that tells equal texts."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", "source", "lang", text.alias("text"), F.regexp_replace(text, _FIRST_CUT, "").alias("rest"), F.md5(text.cast("binary")).alias("digest")
    )


@_query("op4_token_rollups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by two subword vocabularies over all documents, from batches that insert, revise and delete."""
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    counts = {"tokens": ("text", f"{first}.json"), "fewer": ("rest", f"{first}.json"), "others": ("text", f"{second}.tiktoken")}
    docs = widen(_revisable(spark, sf_dir))
    counted = cut_lineage(rollups.token_counts(docs, ["doc_id", "source", "lang", "digest"], counts), "counted")
    return _rolled_up(spark, counted, first, second)


@_query(
    "rollup_words",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS body, source, lang, md5(coalesce(text, '')) AS digest,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
    live AS (SELECT * FROM d WHERE coalesce(doc_id = first_id, true)),
    v AS (
      SELECT source, lang, 'words-1' AS version, {_words(f"regexp_replace(body, '{_FIRST_CUT}', '')")} AS tokens FROM live
      UNION ALL
      SELECT source, lang, 'pieces-2', len(regexp_extract_all(body, '{_PIECES}')) FROM live)
    SELECT source, lang, version, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM v GROUP BY ALL
    """,
)
def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with counts that SQL can state: words and runs of one character class."""
    docs = _revisable(spark, sf_dir)
    counted = docs.select(
        "doc_id",
        "source",
        "lang",
        "digest",
        word_count(F.col("text")).alias("tokens"),
        word_count(F.col("rest")).alias("fewer"),
        F.regexp_count("text", F.lit(_PIECES)).cast("long").alias("others"),
    )
    return _rolled_up(spark, cut_lineage(counted, "counted"), "words-1", "pieces-2")


@_query(
    "op5_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@_query("op6_hilbert_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(_table(spark, sf_dir, "documents"))


@_query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def _path_sql(div: str) -> str:
    """A file tree over the documents, with licence files on three levels."""
    top = "coalesce(source, 'none') || '/' || coalesce(lang, 'none')"
    high, low = (f"CAST({div.format('doc_id', n)} AS STRING)" for n in (4096, 64))
    return f"""CASE WHEN doc_id % 512 = 2 THEN {top} || '/LICENSE-' || CAST(doc_id AS STRING)
      WHEN doc_id % 128 = 1 THEN {top} || '/' || {high} || '/COPYING.' || CAST(doc_id AS STRING)
      WHEN doc_id % 16 = 0 THEN {top} || '/' || {high} || '/' || {low} || '/license.' || CAST(doc_id AS STRING)
      ELSE {top} || '/' || {high} || '/' || {low} || '/' || coalesce(CAST(doc_id AS STRING), 'none') || '.txt' END"""


def _license_sql() -> str:
    names = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))
    cut = "list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda w: w <> '')"
    fold = _fold("coalesce(text, '')")
    return f"""
    WITH t(template, license, notice) AS (VALUES {names}),
    tt AS (SELECT template, license, unnest({cut.format(_fold('notice'))}) AS term FROM t),
    tf AS (SELECT template, license, term, count(*) AS c FROM tt GROUP BY ALL),
    d AS (SELECT doc_id, {_path_sql('({0} // {1})')} AS path, {fold} AS body FROM documents),
    df AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({cut.format('body')})) AS term FROM d) GROUP BY term),
    total AS (SELECT count(*) AS n FROM documents),
    vocab AS (SELECT DISTINCT term FROM tf),
    idf AS (SELECT term, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (term), total),
    tw AS (SELECT template, license, term, c * idf AS w, sqrt(sum((c * idf) * (c * idf)) OVER (PARTITION BY template)) AS norm FROM tf JOIN idf USING (term)),
    l0 AS (SELECT doc_id, string_split(regexp_replace(body, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM d),
    l1 AS (SELECT doc_id, ls, k, unnest(range(1, len(ls) - k + 2)) AS i FROM l0, (SELECT unnest(range(1, {licenses.WINDOW + 1})) AS k)),
    l AS (SELECT doc_id, i * 100 + k AS line, array_to_string(ls[i:i + k - 1], ' ') AS body FROM l1),
    lt AS (SELECT doc_id, line, unnest({cut.format('body')}) AS term FROM l),
    lc AS (SELECT doc_id, line, term, count(*) AS c FROM lt GROUP BY ALL),
    lw AS (SELECT doc_id, line, term, c * coalesce(idf, ln(1 + total.n) + 1) AS w FROM lc LEFT JOIN idf USING (term), total),
    ln AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
    dots AS (SELECT lw.doc_id, lw.line, template, license, sum(lw.w * tw.w / tw.norm) AS dot FROM lw JOIN tw USING (term) GROUP BY ALL),
    sc AS (SELECT doc_id, license, round(dot / norm, 9) AS score FROM dots JOIN ln USING (doc_id, line)),
    own AS (SELECT doc_id, license, score FROM sc WHERE score >= {licenses.LEAST}
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
    f AS (SELECT d.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own.license, own.score FROM d LEFT JOIN own USING (doc_id)),
    g AS (SELECT dir AS above, license AS given, score AS given_score FROM f
      WHERE license IS NOT NULL AND regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$')
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
    inh AS (SELECT u.dir, g.* FROM (SELECT DISTINCT dir FROM f) u JOIN g ON u.dir = g.above OR starts_with(u.dir, g.above || '/')
      QUALIFY row_number() OVER (PARTITION BY u.dir ORDER BY length(g.above) DESC) = 1)
    SELECT doc_id, path, coalesce(license, given) AS license, coalesce(score, given_score) AS score,
      CASE WHEN license IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'directory' ELSE 'none' END AS licensed_by,
      CASE WHEN license IS NULL THEN above END AS from_dir
    FROM f LEFT JOIN inh USING (dir)
    """


@_query("op8_license_scan", _license_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"), F.expr(_path_sql("({0} div {1})")))


@_query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query(
    "op10_mixing",
    rf"""
    WITH a AS (SELECT doc_id, source, text, {_words('text')} AS size FROM documents),
    b AS (SELECT *, coalesce(1.0 / (1.0 + abs(CAST(length(text) AS DOUBLE) / CASE WHEN size > 0 THEN CAST(size AS DOUBLE) END - 6.0) / 6.0), 0.5) AS w FROM a),
    c AS (SELECT doc_id, source, size,
      -ln((CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / w AS key FROM b),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM c GROUP BY source),
    f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * w) AS target FROM f),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    g AS (SELECT source, key, doc_id, size, sum(size) AS part FROM c WHERE size > 0 GROUP BY ALL),
    r AS (SELECT *, sum(part) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS upto FROM g),
    q AS (SELECT r.source, r.key, r.doc_id, r.size, target - epochs * source_size AS budget, upto, part FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
    left_over AS (SELECT source, budget - (upto - part) AS rest FROM q WHERE upto - part < budget AND upto >= budget),
    filler AS (SELECT q.source, key, doc_id, size FROM q JOIN left_over l ON q.source IS NOT DISTINCT FROM l.source
      WHERE upto >= budget AND abs(rest - part) < rest
      QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY abs(rest - part), key, doc_id NULLS FIRST, size) = 1),
    taken AS (SELECT source, key, doc_id, size FROM q WHERE upto < budget UNION ALL SELECT * FROM filler)
    SELECT c.doc_id, c.size, p.source_size, p.target, CAST(c.size * (p.epochs + (taken.key IS NOT NULL)::INT) AS BIGINT) AS taken
    FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
    LEFT JOIN taken ON c.source IS NOT DISTINCT FROM taken.source AND c.key = taken.key AND c.doc_id IS NOT DISTINCT FROM taken.doc_id AND c.size = taken.size
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("repeats")


#: crc32 of a whole number's decimal digits, bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295],
  flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""


@_query(
    "op11_prefix_trie",
    f"""
    WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    d AS (SELECT *, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS digest FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS i FROM d),
    h AS (SELECT conv_id, {_CRC32.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM s)),
    rebuilt AS (
      SELECT h.conv_id, 0 AS own, t.i, text, digest FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.i < h.h
      UNION ALL
      SELECT h.conv_id, 1, t.i, text, digest FROM h JOIN t ON t.conv_id = h.conv_id AND t.i >= h.h),
    p AS (
      SELECT conv_id, row_number() OVER o AS depth, length(text) AS points, string_agg(digest, '') OVER o AS path
      FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY own, i)
      UNION ALL
      SELECT conv_id, 0, 0, '' FROM h),
    n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(points) AS points FROM p GROUP BY path, depth),
    c AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.path = c.path),
    up AS (SELECT left(path, 32 * top) AS path, n_convs, points, n_children FROM (SELECT *, unnest(range(depth + 1)) AS top FROM k)),
    sub AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * points) AS BIGINT) AS saved_tokens FROM up GROUP BY path),
    fin AS (SELECT path, conv_id FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM fin GROUP BY path)
    SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM k JOIN sub ON k.path = sub.path LEFT JOIN e ON k.path = e.path
      LEFT JOIN n q ON k.depth > 0 AND q.path = left(k.path, 32 * (k.depth - 1))
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_nodes(_table(spark, sf_dir, "conversations"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(widen(_table(spark, sf_dir, "documents").select("doc_id", "text")), planted=True)


@_query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(_table(spark, sf_dir, "documents"))
