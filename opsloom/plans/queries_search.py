"""Queries over vectors and retrieval: top-k, keyword legs, fusion, cache, collections, answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from opsloom.functions import intents as I
from opsloom.functions import prompts as P
from opsloom.functions.vectors import cosine_similarity, similarity_from_distance
from opsloom.operators import attribution as A
from opsloom.operators import collections as L
from opsloom.operators import embedding as E
from opsloom.operators import postings
from opsloom.operators import retrieval as R
from opsloom.operators.metrics import histogram, HISTOGRAM_BOUNDS
from opsloom.operators.skew import explode_rows
from opsloom.plans.catalog import query, table, texts
from opsloom.plans.derived import DERIVED, derive, derived_sql
from opsloom.plans.sqltext import sql_list, tokens_sql
from opsloom.session import scratch_dir

QUERY_IDS = [0, 1, 2, 3, 4, 5]
TERMS = ["the", "of", "thing", "and", "network"]

_COS = "round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 6)"


def scores_sql(probe: int, where: str = "true") -> str:
    return (
        f"SELECT e.vec_id, e.label, {_COS} AS similarity FROM embeddings e, "
        f"(SELECT embedding FROM embeddings WHERE vec_id = {probe}) q WHERE {where}"
    )


def _probes(spark, sf_dir, ids):
    """Vectors of the asked ids: the query side of a search, checked to be few."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids))
    return R.read_probes(rows, "vec_id", "embedding")


def _ranked(sql: str, k: int, score: str = "similarity", key: str = "vec_id") -> str:
    return (
        f"SELECT {key}, {score}, row_number() OVER (ORDER BY {score} DESC, {key}) AS rank FROM ({sql}) "
        f"QUALIFY rank <= {k}"
    )


@query("semantic_topk", _ranked(scores_sql(0), 10), ints=("rank",))
def semantic_topk(spark, sf_dir):
    (_, probe), = _probes(spark, sf_dir, [0])
    return R.vector_top_k(table(spark, sf_dir, "embeddings"), probe, 10, "vec_id")


@query(
    "semantic_topk_filtered",
    _ranked(
        scores_sql(0, "e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source LIKE '%rc1%')"), 10
    ),
    ints=("rank",),
)
def semantic_topk_filtered(spark, sf_dir):
    """Metadata filter before ranking; by convention vec_id stands for doc_id here."""
    (_, probe), = _probes(spark, sf_dir, [0])
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("lang").alias("region"), F.col("source").alias("source_path")
    )
    wanted = R.metadata_filter(docs, {"region": "en", "source_path": "rc1", "unknown": "x"})
    corpus = table(spark, sf_dir, "embeddings").join(wanted, "vec_id", "left_semi")
    return R.vector_top_k(corpus, probe, 10, "vec_id")


@query(
    "semantic_topk_per_label",
    f"SELECT vec_id, label, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank "
    f"FROM ({scores_sql(0)}) QUALIFY rank <= 3",
    ints=("rank",),
)
def semantic_topk_per_label(spark, sf_dir):
    (_, probe), = _probes(spark, sf_dir, [0])
    return R.best_per_group(table(spark, sf_dir, "embeddings"), probe, 3, "vec_id", "label")


_MULTI = " UNION ALL ".join(
    f"SELECT {i} AS probe, vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank "
    f"FROM ({scores_sql(p)}) QUALIFY rank <= 10"
    for i, p in enumerate(QUERY_IDS[1:])
)


@query("multi_probe_topk", _MULTI, ints=("rank",))
def multi_probe_topk(spark, sf_dir):
    probes = [(i, v) for i, (_, v) in enumerate(_probes(spark, sf_dir, QUERY_IDS[1:]))]
    out = R.multi_probe_top_k(table(spark, sf_dir, "embeddings"), probes, 10, "vec_id")
    return out.select("probe", "vec_id", "similarity", "rank")


@query(
    "questions_topk",
    """
    SELECT q.vec_id AS question, e.vec_id, round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 6) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON q.label % 2 = 0 OR q.label = e.label QUALIFY rank <= 5
    """,
    ints=("rank",),
)
def questions_topk(spark, sf_dir):
    """A table of questions: every vector asks; those of odd labels see their own label only."""
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.select(F.col("vec_id").alias("question"), "embedding", F.when(F.col("label") % 2 == 1, F.col("label")).alias("label"))
    return R.nearest_to_each(asked, corpus, 5, ["question"], "vec_id", match="label")


_KEYWORD_LEG = f"""
    SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, probe, fetched) AS rank
    FROM (SELECT vec_id, probe, rank AS fetched, similarity FROM ({_MULTI})
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY probe) = 1)
    QUALIFY rank <= 10
"""


@query("keyword_vector_leg", _KEYWORD_LEG, ints=("rank",))
def keyword_vector_leg(spark, sf_dir):
    vectors = [v for _, v in _probes(spark, sf_dir, QUERY_IDS[1:])]
    return R.keyword_vector_leg(table(spark, sf_dir, "embeddings"), vectors, 10, "vec_id")


def bm25_sql(k: int, where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE "
        f"/ (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_ / mean_length))"
        for i in range(len(TERMS))
    )
    any_term = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"""
    WITH counted AS (SELECT doc_id, len(toks) AS len_, {tf} FROM (SELECT doc_id, {tokens_sql("lower(text)")} AS toks FROM documents WHERE {where})),
    stats AS (SELECT count(*) AS n, avg(len_) AS mean_length, {df} FROM counted)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT doc_id, round({score}, 6) AS score FROM counted, stats WHERE {any_term}) QUALIFY rank <= {k}
    """


@query("bm25_topk", bm25_sql(10), ints=("rank",))
def bm25_topk(spark, sf_dir):
    return R.bm25_top_k(texts(spark, sf_dir, "documents", "doc_id", "text"), TERMS, 10, "doc_id", "text")


@query("bm25_postings", bm25_sql(10), ints=("rank",))
def bm25_postings(spark, sf_dir):
    """The same question over a postings table written from all documents."""
    path = scratch_dir(spark, "postings")
    postings.write_postings(texts(spark, sf_dir, "documents", "doc_id", "text"), path, "doc_id", "text")
    return postings.bm25_from_postings(spark, path, TERMS, 10, "doc_id")


def _fused_sql(semantic: str, keyword: str, key: str) -> str:
    return f"""
    WITH legs AS (SELECT {key}, 0.7::DOUBLE / (60 + rank) AS part, 0 AS leg, rank FROM ({semantic})
                  UNION ALL SELECT {key}, 0.3::DOUBLE / (60 + rank), 1, rank FROM ({keyword})),
    fused AS (SELECT {key}, round(sum(part), 12) AS score, min(leg * 1000 + rank) AS seen,
              CASE WHEN count(DISTINCT leg) > 1 THEN 'hybrid' WHEN min(leg) = 0 THEN 'semantic' ELSE 'keyword' END AS method
              FROM legs GROUP BY 1)
    SELECT {key}, round(least(score * 10, 1), 6) AS relevance, method, row_number() OVER (ORDER BY score DESC, seen) AS rank
    FROM fused QUALIFY rank <= 5
    """


@query("rank_fusion", _fused_sql(_ranked(scores_sql(0), 10), _KEYWORD_LEG, "vec_id"), ints=("rank",))
def rank_fusion(spark, sf_dir):
    """Vector leg and keyword-vector leg fused: the search as it runs on a chunk table."""
    probes = [v for _, v in _probes(spark, sf_dir, QUERY_IDS)]
    return R.hybrid_search(
        table(spark, sf_dir, "embeddings"), probes[0], keyword_vectors=probes[1:], top_k=5, id_col="vec_id"
    )


@query(
    "hybrid_search",
    _fused_sql(
        "SELECT vec_id AS doc_id, rank FROM ("
        + _ranked(scores_sql(0, "e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"), 10)
        + ")",
        bm25_sql(10, "lang = 'en'"),
        "doc_id",
    ),
    ints=("rank",),
)
def hybrid_search(spark, sf_dir):
    """The flagship: filter, vector top-k, BM25 top-k, weighted rank fusion.

    By convention ``vec_id`` stands for ``doc_id``.  Texts and vectors are two
    tables here, so each leg ranks all rows of its own.
    """
    (_, probe), = _probes(spark, sf_dir, [0])
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("region"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.hybrid_search(docs, probe, keyword_terms=TERMS, filters={"region": "en"}, id_col="doc_id", vectors=vectors)


@query(
    "cosine_pairs",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity, "
    "round(greatest(0, 1 - (1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS floored "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine_pairs(spark, sf_dir):
    """Similarity of neighbouring vectors: the two-column form."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    sim = a.join(b, "vec_id").select("vec_id", cosine_similarity(F.col("u"), F.col("v")).alias("s"))
    return sim.select(
        "vec_id", F.round("s", 6).alias("similarity"), F.round(similarity_from_distance(1 - F.col("s")), 6).alias("floored")
    )


# --- embedding and cache ----------------------------------------------------
_BUCKET = "CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64"


@query(
    "embed_documents",
    f"""
    WITH toks AS (SELECT doc_id, unnest({tokens_sql("lower(text)")}) AS tok FROM documents),
    counts AS (SELECT doc_id, {_BUCKET} AS dim, count(*) AS n FROM toks GROUP BY 1, 2)
    SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS weight FROM counts
    """,
)
def embed_documents(spark, sf_dir):
    """Vectors of all texts from the offline provider, as non-zero components."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    out = explode_rows(E.embed_column(docs, "text", E.HashingProvider(64)), ["doc_id"], "embedding", "dim", "w")
    return out.where(F.col("w") > 0).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("w").cast("double"), 4).alias("weight")
    )


def _cache(spark, sf_dir):
    """Cache entries of labelled documents; those of low quality are ten days old."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    keyed = docs.select(
        E.embedding_cache_key(F.col("text"), "m").alias("cache_key"),
        F.when(F.col("quality") == 1, F.lit("2024-01-09 00:00:00")).otherwise("2024-01-01 00:00:00").cast("timestamp").alias("cached_at"),
        F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    return keyed.groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"), F.first("embedding").alias("embedding"))


_CACHE_SQL = (
    "(SELECT text, max(CASE WHEN quality = 1 THEN TIMESTAMP '2024-01-09' ELSE TIMESTAMP '2024-01-01' END) AS cached_at "
    "FROM documents JOIN labels USING (doc_id) GROUP BY text)"
)
_NOW = "2024-01-10 00:00:00"


@query(
    "cache_lookup",
    f"SELECT d.doc_id, CAST(CASE WHEN c.text IS NULL THEN NULL ELSE length(d.text) END AS DOUBLE) AS first_component "
    f"FROM documents d LEFT JOIN {_CACHE_SQL} c ON d.text = c.text AND c.cached_at > TIMESTAMP '2024-01-03'",
)
def cache_lookup(spark, sf_dir):
    """Cached vector per document or null; expired entries do not count."""
    live = E.valid_cache(_cache(spark, sf_dir), F.lit(_NOW).cast("timestamp"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.cache_lookup(docs, live, "m").select("doc_id", F.get("embedding", 0).cast("double").alias("first_component"))


@query(
    "cache_misses",
    f"SELECT 'emb:v1:' || substr(md5('m'), 1, 8) || ':' || substr(sha256(text), 1, 32) AS cache_key, text "
    f"FROM (SELECT DISTINCT text FROM documents) WHERE text NOT IN (SELECT text FROM {_CACHE_SQL} WHERE cached_at > TIMESTAMP '2024-01-03')",
)
def cache_misses(spark, sf_dir):
    """Distinct texts that still need a vector."""
    live = E.valid_cache(_cache(spark, sf_dir), F.lit(_NOW).cast("timestamp"))
    return E.missing_texts(table(spark, sf_dir, "documents"), live, "m")


# --- collections ------------------------------------------------------------
@query("existing_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_ids(spark, sf_dir):
    return L.existing_ids(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query(
    "upsert_split",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'update' ELSE 'insert' END AS action FROM documents",
)
def upsert_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    new, known = L.split_new_and_known(docs, table(spark, sf_dir, "labels"), "doc_id")
    return new.withColumn("action", F.lit("insert")).unionByName(known.withColumn("action", F.lit("update")))


@query(
    "upsert_merge",
    "SELECT doc_id, quality, 'new' AS origin FROM labels WHERE toxic = 0 UNION ALL "
    "SELECT doc_id, CAST(n_chars % 100 AS INTEGER), 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)",
)
def upsert_merge(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(n_chars % 100 AS INT) AS quality", "'old' AS origin")
    incoming = table(spark, sf_dir, "labels").where("toxic = 0").selectExpr("doc_id", "quality", "'new' AS origin")
    return L.upsert(stored, incoming, "doc_id")


@query(
    "upsert_counts",
    "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS stored, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS updated, "
    "CAST(0 AS BIGINT) AS skipped FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def upsert_counts(spark, sf_dir):
    return L.merge_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "ingestion_summary",
    "SELECT 'success' AS status, (SELECT count(*) FROM documents) AS documents_loaded, (SELECT count(*) FROM events) AS chunks_created, "
    "count(*) FILTER (WHERE l.doc_id IS NULL) AS chunks_stored, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS chunks_updated, "
    "CAST(0 AS BIGINT) AS chunks_skipped, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT lang || '=' || count(*) AS t FROM documents GROUP BY lang)) AS documents_by_type "
    "FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def ingestion_summary(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    typed = docs.withColumnRenamed("lang", "document_type")
    out = L.ingestion_summary(typed, table(spark, sf_dir, "events"), L.merge_counts(docs, labels, "doc_id"))
    by_type = F.transform(F.map_entries("documents_by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("documents_by_type", F.array_join(by_type, ",")).drop("duration_seconds")


def _chunk_rows(spark, sf_dir):
    """Order lines as chunks of documents: an id each, three to a document."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), F.floor(F.col("event_id") / 3).cast("string")).alias("document_id"),
        F.col("props").alias("content"),
        "event_type",
    )


@query(
    "merge_written",
    """
    SELECT 'c' || event_id AS chunk_id, 'd' || (event_id // 3) AS document_id,
      CASE WHEN event_type = 'click' THEN 'changed ' || props ELSE props END AS content FROM events
    """,
)
def merge_written(spark, sf_dir):
    """A collection written, merged twice with changed and new chunks, and read back."""
    path = scratch_dir(spark, "collection")
    rows = _chunk_rows(spark, sf_dir)
    L.write_collection(rows.where("event_type <> 'view'").drop("event_type"), path, "document_id", rows_per_bucket=2000)
    changed = rows.where("event_type IN ('view', 'click')").withColumn(
        "content", F.when(F.col("event_type") == "click", F.concat(F.lit("changed "), "content")).otherwise(F.col("content"))
    )
    for _ in range(2):
        L.merge_into(spark, path, changed.drop("event_type"))
    return L.read_collection(spark, path).select("chunk_id", "document_id", "content")


# --- answers ----------------------------------------------------------------
def _ranked_documents(spark, sf_dir):
    """All documents per answer, ranked as a retrieval returns them: lines of an order.

    Ranked before the texts are made, so that only narrow rows are shuffled.
    """
    base, columns = DERIVED["ranked"]
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount")
    lines = table(spark, sf_dir, base).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    ranked = lines.withColumn("rank", F.row_number().over(order))
    return ranked.selectExpr(*columns, "rank")


_RANKED_SQL = (
    f"(SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY l_linenumber, l_partkey, relevance) AS rank "
    f"FROM {derived_sql('ranked')})"
)


@query(
    "attribute_sources",
    f"""
    WITH docs AS (SELECT * FROM {_RANKED_SQL}),
    cited AS (SELECT response_id, generate_subscripts(cs, 1) AS pos, TRY_CAST(unnest(cs) AS BIGINT) AS num
              FROM (SELECT response_id, regexp_extract_all(response, '\\[(?:Source\\s*)?(\\d+)\\]', 1) AS cs FROM {derived_sql("answers")})),
    hits AS (SELECT c.response_id, c.pos, d.source_path, d.relevance, substr(d.content, 1, 200) AS excerpt
             FROM cited c JOIN docs d ON d.response_id = c.response_id AND d.rank = c.num),
    explicit AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY response_id, source_path ORDER BY pos) = 1),
    fallback AS (SELECT response_id, rank AS pos, source_path, relevance, CAST(NULL AS VARCHAR) AS excerpt FROM docs
                 WHERE rank <= 3 AND response_id NOT IN (SELECT response_id FROM explicit)
                 AND response_id IN (SELECT o_orderkey FROM orders)
                 QUALIFY row_number() OVER (PARTITION BY response_id, source_path ORDER BY rank) = 1)
    SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY pos) AS position, source_path AS document, relevance, excerpt
    FROM (SELECT * FROM explicit UNION ALL SELECT * FROM fallback)
    """,
    ints=("position",),
)
def attribute_sources(spark, sf_dir):
    return A.attribute(derive(spark, sf_dir, "answers"), _ranked_documents(spark, sf_dir))


@query(
    "context_format",
    f"""
    SELECT response_id, string_agg('[Source ' || CAST(rank AS VARCHAR) || ': ' || source_path || ' (relevance: ' || printf('%.2f', relevance) || ')]' || chr(10)
           || CASE WHEN length(content) > 1500 THEN substr(content, 1, 1500) || '...' ELSE content END,
           chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
    FROM {_RANKED_SQL} GROUP BY 1
    """,
)
def context_format(spark, sf_dir):
    return A.response_context(_ranked_documents(spark, sf_dir))


@query(
    "answer_confidence",
    f"""
    WITH docs AS (SELECT response_id, count(*) AS n, avg(relevance) AS rel FROM {_RANKED_SQL} GROUP BY 1),
    tools AS (SELECT event_id AS response_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT a.o_orderkey AS response_id,
           round(CASE WHEN d.n IS NULL AND t.n IS NULL THEN 0.3
           ELSE least(1, least(coalesce(d.n, 0) / 3, 1) * 0.5 + least(coalesce(t.n, 0) / 2, 1) * 0.3 + coalesce(d.rel, 0) * 0.2) END, 6) AS confidence
    FROM orders a LEFT JOIN docs d ON d.response_id = a.o_orderkey LEFT JOIN tools t ON t.response_id = a.o_orderkey
    """,
)
def answer_confidence(spark, sf_dir):
    docs = _ranked_documents(spark, sf_dir)
    tools = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("event_id AS response_id")
    out = A.confidence(derive(spark, sf_dir, "answers"), docs, tools)
    return out.select("response_id", F.round("confidence", 6).alias("confidence"))


@query(
    "prompt_build",
    f"""
    SELECT message_id, '### Retrieved Documentation ###' || chr(10) || 'ctx ' || CAST(message_id AS VARCHAR) || chr(10) || chr(10)
      || CASE WHEN message_id % 2 = 0 THEN '### Live Data from Tools ###' || chr(10) || chr(10) || 'Tool Result 1:' || chr(10) || '  id: ' || CAST(session_id AS VARCHAR) || chr(10) || chr(10) ELSE '' END
      || '### User Query ###' || chr(10) || content AS prompt,
      'base' || CASE WHEN session_id % 2 = 0 THEN chr(10) || 'Focus region: region_a' ELSE '' END || chr(10) || 'Priority level: high' AS system_text
    FROM {derived_sql("chat")}
    """,
)
def prompt_build(spark, sf_dir):
    """Prompt parts per message; the hidden key of a tool result is left out."""
    chat = derive(spark, sf_dir, "chat").withColumns(
        {
            "query": F.col("content"),
            "context": F.concat(F.lit("ctx "), F.col("message_id").cast("string")),
            "tool_results": F.when(
                F.col("message_id") % 2 == 0,
                F.array(F.create_map(F.lit("id"), F.col("session_id").cast("string"), F.lit("_raw"), F.lit("x"))),
            ),
            "system": P.system_context(F.when(F.col("session_id") % 2 == 0, F.lit("region_a")), F.lit("high"), "base"),
            "history": F.lit(None).cast("array<struct<role:string,content:string>>"),
        }
    )
    out = A.build_messages(chat)
    return out.select("message_id", F.get("messages", 1)["content"].alias("prompt"), F.get("messages", 0)["content"].alias("system_text"))


@query(
    "fallback_answer",
    f"""
    SELECT response_id, CASE WHEN response_id % 3 = 0 THEN {sql_list([P.FALLBACK_NONE])} ELSE
      'I found relevant information in: ' || string_agg(substr(source_path, 1, 50), ', ' ORDER BY rank) || {sql_list([P.FALLBACK_FOUND_END])} END AS answer
    FROM {_RANKED_SQL} WHERE rank <= 3 GROUP BY response_id
    """,
)
def fallback_answer(spark, sf_dir):
    top = _ranked_documents(spark, sf_dir).where(F.col("rank") <= 3)
    lists = top.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_path"))).alias("d"))
    sources = F.when(F.col("response_id") % 3 != 0, F.transform("d", lambda x: x["source_path"]))
    return lists.select("response_id", P.fallback_text(sources).alias("answer"))


_BOUNDS = HISTOGRAM_BOUNDS["rag_relevance_score"]


@query(
    "relevance_histogram",
    " UNION ALL ".join(
        f"SELECT CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE similarity <= {b}) AS bucket_count, count(*) AS observations, round(sum(similarity), 3) AS total FROM ({scores_sql(0)})"
        for b in _BOUNDS
    )
    + f" UNION ALL SELECT NULL, count(*), count(*), round(sum(similarity), 3) FROM ({scores_sql(0)})",
)
def relevance_histogram(spark, sf_dir):
    (_, probe), = _probes(spark, sf_dir, [0])
    scored = R.score_against(table(spark, sf_dir, "embeddings"), "embedding", [probe])
    return histogram(scored.select(F.get("scores", 0).alias("s")), "s", _BOUNDS).withColumn("total", F.round("total", 3))


@query(
    "search_keywords",
    f"""
    SELECT message_id, array_to_string(list_sort(list_distinct(list_concat(
        regexp_extract_all(content, '(?i)node[_\\-]?\\d+'), regexp_extract_all(content, '(?i)[ce]r[_\\-][a-z][_\\-]\\d+'),
        regexp_extract_all(content, '(?i)(eth|ge|xe)\\d+', 1), regexp_extract_all(content, '(?i)region[_\\s]?[a-z]'),
        regexp_extract_all(content, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}'),
        list_filter([{sql_list(I.DOMAIN_TERMS)}], lambda t: contains(lower(content), t))))), '|') AS keywords
    FROM {derived_sql("chat")}
    """,
)
def search_keywords(spark, sf_dir):
    chat = derive(spark, sf_dir, "chat")
    return chat.select("message_id", F.array_join(F.sort_array(I.search_keywords(F.col("content"))), "|").alias("keywords"))
