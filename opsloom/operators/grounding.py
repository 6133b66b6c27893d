"""Grounding checks: term detector and overlap detector, per claim and per response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions import claims as C
from opsloom.functions.text import let, tokens
from opsloom.operators.skew import explode_rows, lookup
from opsloom.session import cut_lineage

MIN_GROUNDED_RATIO = 0.8
GROUNDING_THRESHOLD = 0.7
SHOWN_UNGROUNDED = 3


def term_claim_rows(responses: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per claim of the term detector: kept columns, claim_index, claim."""
    return explode_rows(responses, keep, C.term_claims(F.col(text)), "claim_index", "claim")


def overlap_claim_rows(responses: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per distinct claim of the overlap detector."""
    return explode_rows(responses, keep, C.overlap_claims(F.col(text)), "claim_index", "claim")


def check_terms(
    responses: DataFrame,
    text: str = "response",
    context: str = "context_docs",
    sources: str | None = None,
    threshold: float = C.SIMILARITY_THRESHOLD,
    min_ratio: float = MIN_GROUNDED_RATIO,
) -> DataFrame:
    """Add the term detector's verdict per response; no shuffle, all inside the row.

    ``context`` is an array of evidence texts.  Adds ``claims`` (array of
    text, grounded, confidence, source), ``grounded_count``,
    ``ungrounded_count``, ``confidence_score``, ``is_grounded`` and
    ``explanation``.
    """
    no_sources = F.array().cast("array<string>")
    given = F.coalesce(F.col(sources), no_sources) if sources else no_sources
    evidence = F.struct(F.lower(F.array_join(F.col(context), " ")).alias("text"))
    none = F.array().cast("array<string>")

    def claim_verdicts(found: Column) -> Column:
        # the context is read only for responses that claim something, its numbers only where a claim has some
        def with_numbers(e: Column) -> Column:
            numbered = F.exists(found, lambda c: c.rlike(r"\p{Nd}"))
            return F.struct(e["text"].alias("text"), F.when(numbered, C.numbers(e["text"])).otherwise(none).alias("numbers"))

        def verdicts(e: Column) -> Column:
            def verdict(claim: Column) -> Column:
                parts = F.struct(C.key_terms(F.lower(claim)).alias("terms"), C.numbers(claim).alias("numbers"))

                def scored(c: Column) -> Column:
                    sure = C.term_confidence(c["terms"], c["numbers"], e["text"], e["numbers"])
                    return F.struct(c["terms"].alias("terms"), sure.alias("sure"))

                def judged(c: Column) -> Column:
                    grounded = (F.size(c["terms"]) == 0) | (c["sure"] >= threshold)
                    source = F.when(grounded & (F.size(c["terms"]) > 0), C.supporting_source(c["terms"], given))
                    return F.struct(
                        claim.alias("text"), grounded.alias("grounded"), c["sure"].alias("confidence"), source.alias("source")
                    )

                return let(let(parts, scored), judged)

            return F.transform(found, verdict).cast(_CLAIMS)

        return F.when(F.size(found) > 0, let(let(evidence, with_numbers), verdicts)).otherwise(F.array().cast(_CLAIMS))

    empty = F.col(text).isNull() | (F.length(text) == 0) | F.col(context).isNull() | (F.size(context) == 0)
    claims = F.when(~empty, let(C.term_claims(F.col(text)), claim_verdicts))

    def counted(c: Column) -> Column:
        found = F.coalesce(c, F.array().cast(_CLAIMS))
        return F.struct(
            c.isNull().alias("empty"), found.alias("claims"), F.size(found).alias("n"),
            F.size(F.filter(found, lambda x: x["grounded"])).alias("g"),
        )

    def rated(s: Column) -> Column:
        score = F.when(s["empty"], 0.0).otherwise(F.coalesce(F.try_divide(s["g"], s["n"]), F.lit(1.0)))
        passed = ~s["empty"] & (score >= min_ratio)
        shown = F.transform(
            F.slice(F.filter(s["claims"], lambda c: ~c["grounded"]), 1, SHOWN_UNGROUNDED),
            lambda c: F.concat(F.lit("'"), c["text"], F.lit("'")),
        )
        ratio = F.concat(s["g"].cast("string"), F.lit("/"), s["n"].cast("string"))
        explanation = (
            F.when(s["empty"], "Empty response or context")
            .when(s["n"] == 0, "No verifiable claims found")
            .when(passed, F.concat(ratio, F.lit(" claims are grounded in context")))
            .otherwise(
                F.concat(
                    F.lit("Only "), ratio, F.lit(" claims grounded. Ungrounded: ["), F.array_join(shown, ", "), F.lit("]")
                )
            )
        )
        return F.struct(
            s["claims"].alias("claims"), s["g"].alias("grounded_count"), (s["n"] - s["g"]).alias("ungrounded_count"),
            score.alias("confidence_score"), passed.alias("is_grounded"), explanation.alias("explanation"),
        )

    return responses.withColumn("__v", let(let(claims, counted), rated)).select(*responses.columns, "__v.*")


_CLAIMS = "array<struct<text:string,grounded:boolean,confidence:double,source:string>>"


def evidence_rows(documents: DataFrame, tool_results: DataFrame, key: str = "response_id") -> DataFrame:
    """Evidence of both kinds as one table: key, evidence.

    ``documents``: key, content (empty ones dropped).  ``tool_results``: key,
    result as text.
    """
    docs = documents.where(F.length("content") > 0).select(key, F.col("content").alias("evidence"))
    return docs.unionByName(tool_results.select(key, F.col("result").alias("evidence")))


def check_overlap(
    responses: DataFrame, text: str = "response", evidence: str = "evidence", threshold: float = GROUNDING_THRESHOLD
) -> DataFrame:
    """Add the overlap detector's verdict per response; ``evidence`` is an array of texts.

    Adds ``claim_count``, ``grounding_score``, ``ungrounded_claims``,
    ``is_grounded`` and ``recommendation``.
    """
    texts = F.coalesce(F.col(evidence), F.array().cast("array<string>"))
    worded = F.coalesce(
        F.transform(
            C.overlap_claims(F.col(text)),
            lambda c: F.struct(c.alias("text"), C.overlap_keywords(c).alias("words")),
        ),
        F.array().cast(_WORDED),
    )

    def met(c: Column) -> Column:
        asked = F.array_distinct(F.flatten(F.transform(c, lambda x: x["words"])))

        def shared(a: Column) -> Column:
            # evidence is cut to words of the claims once, and not read where nothing is claimed
            cut = F.transform(texts, lambda e: F.array_intersect(tokens(F.lower(e)), a))
            return F.when(F.size(a) > 0, cut).otherwise(F.array().cast("array<array<string>>"))

        return F.struct(c.alias("claims"), let(asked, shared).alias("tokens"))

    def judged(s: Column) -> Column:
        unsupported = F.filter(s["claims"], lambda c: ~C.is_supported(c["words"], s["tokens"]))
        return F.struct(
            F.size(s["claims"]).alias("n"), F.transform(unsupported, lambda c: c["text"]).alias("open")
        )

    def rated(s: Column) -> Column:
        bad = F.size(s["open"])
        score = F.coalesce(F.try_divide(s["n"] - bad, s["n"]), F.lit(1.0))
        advice = F.when(s["n"] == 0, "No factual claims detected").otherwise(C.recommendation(score, bad, threshold))
        return F.struct(
            s["n"].alias("claim_count"), score.alias("grounding_score"), s["open"].alias("ungrounded_claims"),
            (score >= threshold).alias("is_grounded"), advice.alias("recommendation"),
        )

    return responses.withColumn("__v", let(let(let(worded, met), judged), rated)).select(*responses.columns, "__v.*")


_WORDED = "array<struct<text:string,words:array<string>>>"


def check_overlap_rows(
    responses: DataFrame, evidence: DataFrame, key: str = "response_id", text: str = "response",
    threshold: float = GROUNDING_THRESHOLD,
) -> DataFrame:
    """The overlap verdict when evidence is a table of any size per response.

    Each evidence row is given its response's claims and marks the ones it
    supports, inside the row; marks are then reduced per claim, map-side
    first.  A response that owns a third of all evidence is served from a
    broadcast of its claims, so its evidence rows stay where they are.
    Returns key, claim_count, grounding_score, is_grounded, recommendation.
    """
    worded = F.transform(C.overlap_claims(F.col(text)), C.overlap_keywords)
    # read three times below
    claims = cut_lineage(responses.select(key, worded.alias("claim_words")), "claims")
    given = lookup(evidence.select(key, "evidence"), claims, key, ["claim_words"])
    tokens = F.array(F.col("__tokens"))
    tokenized = given.withColumn("__tokens", C.token_set(F.col("evidence")))
    marks = (
        explode_rows(tokenized, [key, "__tokens"], "claim_words", "claim_index", "words")
        .where((F.size("words") > 0) & C.is_supported(F.col("words"), tokens))
        .select(key, "claim_index")
        .distinct()
    )
    supported = marks.groupBy(key).agg(F.count("*").alias("__supported"))
    free = F.size(F.filter("claim_words", lambda w: F.size(w) == 0))
    n, bad = F.col("claim_count"), F.col("__bad")
    return (
        claims.join(supported, key, "left")
        .select(
            key,
            F.size("claim_words").alias("claim_count"),
            (F.size("claim_words") - free - F.coalesce("__supported", F.lit(0))).alias("__bad"),
        )
        .withColumn("grounding_score", F.coalesce(F.try_divide(n - bad, n), F.lit(1.0)))
        .select(
            key,
            "claim_count",
            "grounding_score",
            (F.col("grounding_score") >= threshold).alias("is_grounded"),
            F.when(n == 0, "No factual claims detected")
            .otherwise(C.recommendation(F.col("grounding_score"), bad, threshold))
            .alias("recommendation"),
        )
    )
