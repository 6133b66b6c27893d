"""Hybrid search: filtered vector top-k, keyword legs, weighted rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.text import let, tokens
from opsloom.functions.vectors import MAX_PROBES, local_top_k, nearest_pairs, probe_scores
from opsloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------
RRF_K = 60
SEMANTIC_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
RELEVANCE_SCALE = 10
TOP_K = 5
OVERFETCH = 2
MAX_KEYWORDS = 5
BM25_K1 = 1.2
BM25_B = 0.75
# --- end of fixed values ----------------------------------------------------

#: scores are compared at this many decimals, so that ties break by id everywhere
SCORE_DIGITS = 6


def metadata_filter(corpus: DataFrame, filters: dict | None) -> DataFrame:
    """Keep rows matching ``region`` and ``doc_type`` exactly and containing ``source_path``.

    Other keys are ignored; no usable key means no filter.  Apply it before
    scoring: the conditions reach the file scan.
    """
    filters = filters or {}
    if "region" in filters:
        corpus = corpus.where(F.col("region") == filters["region"])
    if "doc_type" in filters:
        corpus = corpus.where(F.col("document_type") == filters["doc_type"])
    if "source_path" in filters:
        corpus = corpus.where(F.col("source_path").contains(filters["source_path"]))
    return corpus


def read_probes(vectors: DataFrame, id_col: str, vector_col: str) -> list[tuple]:
    """Bring a few probe vectors to the driver; :func:`nearest_to_each` takes any number as a table."""
    rows = vectors.select(id_col, vector_col).orderBy(id_col).limit(MAX_PROBES + 1).collect()
    if len(rows) > MAX_PROBES:
        raise ValueError(f"more than {MAX_PROBES} probe vectors: pass them as a table to nearest_to_each")
    return [(r[0], list(r[1])) for r in rows]


def score_against(corpus: DataFrame, vector: str, probes: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``scores``: rounded cosine similarity with each probe, floored at zero."""

    def floored(s: Column) -> Column:
        # greatest() would turn a missing score into zero
        return F.when(s.isNotNull(), F.round(F.greatest(s, F.lit(0.0)), SCORE_DIGITS))

    return corpus.withColumn("scores", F.transform(probe_scores(F.col(vector), probes), floored))


def vector_top_k(corpus: DataFrame, probe: Sequence[float], k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one probe: id, similarity, rank.

    Each partition keeps its own best ``k``; only those meet.
    """
    scored = score_against(corpus.select(id_col, vector), vector, [probe])
    best = (
        scored.select(id_col, F.get("scores", 0).alias("similarity"))
        .where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), id_col)
        .limit(k)
    )
    return with_rank(best, "similarity", id_col)


def with_rank(hits: DataFrame, score: str, id_col: str, partition: str | None = None) -> DataFrame:
    """1-based rank by score, ties by id.  Only for results already cut to a top-k."""
    window = Window.partitionBy(partition) if partition else Window.partitionBy(F.lit(0))
    return hits.withColumn("rank", F.row_number().over(window.orderBy(F.desc(score), id_col)))


def multi_probe_top_k(
    corpus: DataFrame, probes: Sequence[tuple], k: int, id_col: str, vector: str = "embedding"
) -> DataFrame:
    """Top ``k`` per probe: probe, id, similarity, rank.

    ``probes`` are ``(probe_id, vector)`` pairs held by the caller; they are
    sent to the tasks in blocks, one scan for each block.  Every batch passes
    on its own best ``k`` per probe and nothing else.
    """

    def near(block: Sequence[tuple]) -> DataFrame:
        names = F.array(*[F.lit(p[0]) for p in block])
        found = local_top_k(corpus, id_col, vector, [p[1] for p in block], k, SCORE_DIGITS)
        return found.withColumn("probe", F.get(names, F.col("probe")))

    blocks = [near(probes[i : i + MAX_PROBES]) for i in range(0, len(probes), MAX_PROBES)]
    return with_rank(reduce(DataFrame.unionByName, blocks), "similarity", id_col, "probe").where(F.col("rank") <= k)


#: rows of a corpus, and probes, that meet in one task group, at most; of wide vectors only so many that a block holds BLOCK_NUMBERS
CORPUS_BLOCK, PROBE_BLOCK, BLOCK_NUMBERS = 32_768, 32_768, 4_194_304
#: probes of a small table are cut further, until there are so many groups for each core
GROUPS_A_CORE, FEWEST_PROBES = 4, 512


def _blocks(rows: tuple[int, int], probes: tuple[int, int], cores: int) -> tuple[int, int]:
    """Blocks of rows and of probes; both sides are given by their number and width."""

    def cut(count: int, width: int, most: int) -> int:
        return max(1, -(-count // max(1, min(most, BLOCK_NUMBERS // max(width, 1)))))

    blocks = cut(*rows, CORPUS_BLOCK)
    wanted = -(-GROUPS_A_CORE * cores // blocks)
    return blocks, max(cut(*probes, PROBE_BLOCK), min(wanted, cut(*probes, min(PROBE_BLOCK, FEWEST_PROBES))))


def nearest_to_each(
    probes: DataFrame, corpus: DataFrame, k: int, keys: list[str], id_col: str, vector: str = "embedding", match: str | None = None
) -> DataFrame:
    """Top ``k`` of a corpus for every row of a table of probes: keys, id, similarity, rank.

    ``probes`` has the ``keys`` that name a probe and a ``vector``; there may be
    any number of them.  Both sides are cut into blocks by a hash, and each
    block of probes meets each block of the corpus in one task group, which
    passes on its best ``k`` per probe.  With ``match``, a probe sees only rows
    whose value of that column equals its own; a null value sees all.

    All pairs are computed, so the work is that of one product of matrices.
    Rows are copied once per block of the other side: blocks are as large as a
    task can hold, so that copies stay few.
    """

    def size(side: DataFrame) -> tuple[int, int]:
        found = side.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
        return found["n"], found["width"] or 0

    blocks, turns = _blocks(size(corpus), size(probes), corpus.sparkSession.sparkContext.defaultParallelism)
    matched = [match] if match else []

    def spread(names: list[str], count: int) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    group = ["__block", "__turn"]
    left = probes.select(*keys, vector, *matched).withColumn("__turn", spread(keys, turns)).withColumn("__block", each(blocks))
    right = corpus.select(id_col, vector, *matched).withColumn("__block", spread([id_col], blocks)).withColumn("__turn", each(turns))

    def met(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        # among equal similarities the earlier row of the block wins
        rows = rows.sort_values(id_col, na_position="first", ignore_index=True)
        pairs = [(np.arange(len(asking)), np.arange(len(rows)))]
        if match:
            held = rows.groupby(match).indices
            own = [(at, held[value]) for value, at in asking.groupby(match).indices.items() if value in held]
            pairs = [(np.flatnonzero(asking[match].isna()), pairs[0][1]), *own]
        parts = []
        for asked, seen in pairs:
            probe, row, similarity = nearest_pairs(asking[vector].iloc[asked], rows[vector].iloc[seen], k, SCORE_DIGITS)
            named = {key: asking[key].to_numpy()[asked[probe]] for key in keys}
            parts.append(pd.DataFrame(named | {id_col: rows[id_col].to_numpy()[seen[row]], "similarity": similarity}))
        return pd.concat(parts)

    types = dict(probes.dtypes) | {id_col: dict(corpus.dtypes)[id_col]}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, id_col]) + ", similarity double"
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(met, schema)
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_group(
    corpus: DataFrame, probe: Sequence[float], k: int, id_col: str, group: str, vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows nearest to one probe within each group, cut before the shuffle."""
    scored = score_against(corpus.select(id_col, group, vector), vector, [probe])
    flat = scored.select(id_col, group, F.get("scores", 0).alias("similarity"))
    return with_rank(flat.where(F.col("similarity").isNotNull()), "similarity", id_col, group).where(F.col("rank") <= k)


def keyword_vector_leg(
    corpus: DataFrame, keyword_vectors: Sequence[Sequence[float]], k: int, id_col: str, vector: str = "embedding"
) -> DataFrame:
    """Keyword leg over vectors of up to five keywords: id, similarity, rank.

    Each keyword fetches its top ``k``.  A document keeps the score of the
    first keyword that fetched it, not its best; the union is ranked by score,
    ties in the order fetched, and cut to ``k``.
    """
    probes = list(enumerate(keyword_vectors[:MAX_KEYWORDS]))
    fetched = multi_probe_top_k(corpus, probes, k, id_col, vector)
    return first_hits(fetched.withColumn("__q", F.lit(0)), "__q", k, id_col).drop("__q")


def first_hits(fetched: DataFrame, question: str, k: int, id_col: str) -> DataFrame:
    """First-hit rule per question over a few fetched rows: question, id, similarity, rank."""
    first = fetched.groupBy(question, id_col).agg(F.min(F.struct("probe", "rank", "similarity")).alias("hit"))
    order = Window.partitionBy(question).orderBy(F.desc("similarity"), "probe", "fetched")
    flat = first.select(
        question, id_col, F.col("hit.probe").alias("probe"), F.col("hit.rank").alias("fetched"), F.col("hit.similarity").alias("similarity")
    )
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        question, id_col, "similarity", "rank"
    )


def bm25_top_k(corpus: DataFrame, terms: Sequence[str], k: int, id_col: str, text: str = "content") -> DataFrame:
    """Top ``k`` documents by BM25 over all query terms: id, score, rank.

    The texts are read once and reduced to their term counts, a few numbers per
    document that are written to the shared folder: one pass over them gives
    corpus size, mean length and document frequencies, the other the scores.
    Many questions over one corpus are cheaper from its postings
    (:mod:`opsloom.operators.postings`).
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))

    def counts(toks: Column) -> Column:
        found = [(F.size(toks) - F.size(F.array_remove(toks, t))).alias(f"tf{i}") for i, t in enumerate(terms)]
        return F.struct(F.size(toks).alias("length"), *found)

    counted = cut_lineage(corpus.select(id_col, let(tokens(F.lower(F.col(text))), counts).alias("d")), "term-counts")
    stats = counted.agg(
        F.count("*").alias("n"),
        F.avg("d.length").alias("mean_length"),
        *[F.count_if(F.col(f"d.tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )

    def score(d: Column) -> Column:
        s = F.col("__stats")
        total, hits = F.lit(0.0), F.lit(0)
        for i in range(len(terms)):
            tf, df = d[f"tf{i}"], s[f"df{i}"]
            idf = F.log(F.lit(1.0) + (s["n"] - df + 0.5) / (df + 0.5))
            length_part = F.lit(1.0 - BM25_B) + F.lit(BM25_B) * d["length"] / s["mean_length"]
            total = total + idf * (tf * (BM25_K1 + 1.0)) / (tf + F.lit(BM25_K1) * length_part)
            hits = hits + tf
        return F.when(hits > 0, F.round(total, SCORE_DIGITS))

    # documents without any term have no score and sort last; they are dropped
    # after the limit, as an earlier filter would count the tokens twice
    best = (
        counted.withColumn("__stats", stats.select(F.struct("*")).scalar())
        .select(id_col, score(F.col("d")).alias("score"))
        .orderBy(F.desc_nulls_last("score"), id_col)
        .limit(k)
        .where(F.col("score").isNotNull())
    )
    return with_rank(best, "score", id_col)


def fuse_ranks(
    semantic: DataFrame, keyword: DataFrame | None, k: int, id_col: str, question: str | None = None
) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked legs: id, relevance, method, rank.

    Inputs carry ``id_col`` and ``rank`` (and ``question``, to fuse several
    searches at once).  Relevance is ten times the fused score, at most 1; ties
    go to the document listed first (semantic leg first).
    """
    keys = [question] if question else []

    def leg(hits: DataFrame, weight: float, ord_: int, name: str) -> DataFrame:
        return hits.select(
            *keys,
            id_col,
            (F.lit(weight) / (F.lit(RRF_K) + F.col("rank"))).alias("part"),
            F.struct(F.lit(ord_).alias("leg"), F.col("rank").alias("rank")).alias("seen"),
            F.lit(name).alias("method"),
        )

    legs = leg(semantic, SEMANTIC_WEIGHT, 0, "semantic")
    if keyword is not None:
        legs = legs.unionByName(leg(keyword, KEYWORD_WEIGHT, 1, "keyword"))
    method = F.when(F.min("method") != F.max("method"), "hybrid").otherwise(F.min("method"))
    fused = legs.groupBy(*keys, id_col).agg(
        F.round(F.sum("part"), 12).alias("__score"), F.min("seen").alias("__seen"), method.alias("method")
    )
    # both legs were cut to a few rows per question
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = fused.withColumn("rank", F.row_number().over(order.orderBy(F.desc("__score"), "__seen")))
    return ranked.where(F.col("rank") <= k).select(
        *keys,
        id_col,
        F.round(F.least(F.col("__score") * RELEVANCE_SCALE, F.lit(1.0)), SCORE_DIGITS).alias("relevance"),
        "method",
        "rank",
    )


def search_many(
    corpus: DataFrame, questions: Sequence[tuple], top_k: int = TOP_K, id_col: str = "chunk_id", vector: str = "embedding"
) -> DataFrame:
    """Hybrid search for several questions in one scan: question, id, relevance, method, rank.

    ``questions`` are ``(question_id, vector, keyword_vectors)``.
    """
    fetch = top_k * OVERFETCH
    probes, owners = [], []
    for q, (_, query, keywords) in enumerate(questions):
        for ord_, probe in enumerate([query, *keywords[:MAX_KEYWORDS]]):
            owners.append((q, ord_))
            probes.append((len(probes), probe))
    found = multi_probe_top_k(corpus, probes, fetch, id_col, vector)
    owner = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(o).alias("o")) for q, o in owners])
    placed = found.withColumn("__owner", F.get(owner, F.col("probe"))).select(
        F.get(F.array(*[F.lit(q[0]) for q in questions]), F.col("__owner.q")).alias("question"),
        F.col("__owner.o").alias("probe"), id_col, "similarity", "rank",
    )
    keyword = first_hits(placed.where(F.col("probe") > 0), "question", fetch, id_col)
    return fuse_ranks(placed.where(F.col("probe") == 0), keyword, top_k, id_col, "question")


def hybrid_search(
    corpus: DataFrame,
    probe: Sequence[float],
    keyword_vectors: Sequence[Sequence[float]] = (),
    keyword_terms: Sequence[str] = (),
    top_k: int = TOP_K,
    filters: dict | None = None,
    semantic_only: bool = False,
    id_col: str = "chunk_id",
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Search a corpus with ``id_col``, ``content``, ``embedding`` and metadata columns.

    Where vectors are kept apart from texts (``vectors``: ``id_col`` and
    ``embedding``), each leg ranks all of its own rows and the fusion joins
    them; filters then apply to the vectors through the ids of the corpus.

    The keyword leg uses keyword vectors when given, otherwise BM25 over
    ``keyword_terms``; without either (or with ``semantic_only``) the vector
    leg alone is ranked.
    """
    corpus = metadata_filter(corpus, filters)
    fetch = top_k * OVERFETCH
    embedded = corpus
    if vectors is not None:
        embedded = vectors.join(corpus.select(id_col), id_col, "left_semi") if filters else vectors
    semantic = vector_top_k(embedded, probe, fetch, id_col)
    keyword = None
    if not semantic_only and keyword_vectors:
        keyword = keyword_vector_leg(embedded, keyword_vectors, fetch, id_col)
    elif not semantic_only and keyword_terms:
        keyword = bm25_top_k(corpus, keyword_terms, fetch, id_col)
    return fuse_ranks(semantic, keyword, top_k, id_col)
