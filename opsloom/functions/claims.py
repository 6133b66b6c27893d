"""Claim extraction and evidence checks as column expressions.

Two detectors, as in the data model: the *term* detector compares a response
with one joined context, the *overlap* detector looks for one evidence text
that shares enough words with a claim.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opsloom.functions.text import WORD, contains_any, let, strip, tokens

# --- fixed values -----------------------------------------------------------
HEDGES = ["might", "maybe", "perhaps", "possibly", "could be", "i think", "i believe", "it seems"]
DEFINITIVE_WORDS = [
    "is", "are", "was", "were", "has", "have", "will", "always", "never", "must", "should",
]
TERM_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by",
    "from", "as", "into", "through", "during", "before", "after", "above", "below", "between",
    "under", "again", "further", "then", "once", "and", "but", "or", "nor", "so", "yet", "both",
    "either", "neither", "not", "only", "own", "same", "than", "too", "very", "just", "also",
    "now", "here", "there", "when", "where", "why", "how", "all", "each", "every", "few", "more",
    "most", "other", "some", "such", "no", "any", "this", "that", "these", "those", "it", "its",
]
STATUS_WORDS = [
    "operational", "degraded", "down", "healthy", "compliant", "breached", "exceeded", "below",
    "active", "inactive", "failed", "restored",
]
CONFIG_WORDS = [
    "configured", "setting", "threshold", "parameter", "policy", "rule", "limit", "capacity",
]
OVERLAP_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "has", "have", "been", "be", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "of", "in", "to", "for", "with", "on",
    "at", "from", "by", "about", "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "and", "but", "or",
]
SENTENCE_END = r"[.!?]+"
NUMBER = r"\p{Nd}+\.?\p{Nd}*"
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
MIN_SENTENCE = 10
MAX_TERMS = 10
TERM_WEIGHT = 0.7
NUMBER_WEIGHT = 0.3
SIMILARITY_THRESHOLD = 0.7
NO_TERM_CONFIDENCE = 0.8
OVERLAP_RATIO = 0.5
#: advice by grounding score; the number of open claims stands between the parts of the second
ADVICE_GOOD = "Response well-grounded in sources. Safe to present."
ADVICE_MOSTLY = ("Response mostly grounded. ", " claim(s) lack direct source support. Consider adding caveats.")
ADVICE_PARTLY = (
    "Response partially grounded. Recommend human review before presenting to user. "
    "Ungrounded claims should be removed or flagged as uncertain."
)
ADVICE_POOR = "Response poorly grounded. Recommend escalation to human operator. Do not present as authoritative."
ADVICE_GOOD_FROM, ADVICE_PARTLY_FROM = 0.9, 0.4
# --- end of fixed values ----------------------------------------------------


def term_claims(text: Column) -> Column:
    """Sentences that state something: long enough, not hedged, with a digit or a definitive word."""

    def is_claim(sentence: Column) -> Column:
        def stated(lowered: Column) -> Column:
            definite = contains_any(lowered, DEFINITIVE_WORDS) | sentence.rlike(r"\p{Nd}")
            return definite & ~contains_any(lowered, HEDGES)

        return (F.length(sentence) >= MIN_SENTENCE) & let(F.lower(sentence), stated)

    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), is_claim)


def key_terms(lowered: Column) -> Column:
    """The first ten plain ``a-z`` words longer than two letters that are no stop words.

    A word with any other letter or digit in it is not a plain word.
    """
    plain = rf"(?<!{WORD})[a-z]{{3,}}+(?!{WORD})"
    found = F.regexp_extract_all(lowered, F.lit(plain), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(TERM_STOP_WORDS)), 1, MAX_TERMS)


def numbers(text: Column) -> Column:
    """Distinct numbers as written; a trailing full stop stays part of the number."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def term_match_ratio(terms: Column, context: Column) -> Column:
    """Share of terms that occur in the lower-case context; null when there are none."""
    found = F.size(F.filter(terms, lambda t: F.contains(context, t)))
    return F.try_divide(found, F.size(terms))


def term_confidence(terms: Column, claim_numbers: Column, context: Column, context_numbers: Column) -> Column:
    """Confidence of one claim: term share weighted 0.7, plus 0.3 when its numbers are known."""
    known = F.size(F.array_except(claim_numbers, context_numbers)) == 0
    scored = term_match_ratio(terms, context) * TERM_WEIGHT + F.when(known, NUMBER_WEIGHT).otherwise(0.0)
    return F.coalesce(scored, F.lit(NO_TERM_CONFIDENCE))


def supporting_source(terms: Column, sources: Column) -> Column:
    """First source that names one of the first two terms."""
    lead = F.slice(terms, 1, 2)
    hits = F.filter(sources, lambda s: F.exists(lead, lambda t: F.contains(F.lower(s), t)))
    return F.get(hits, 0)


def overlap_claims(text: Column) -> Column:
    """Distinct sentences with a digit, a status word or a configuration word."""

    def is_claim(sentence: Column) -> Column:
        known = let(F.lower(sentence), lambda low: contains_any(low, [*STATUS_WORDS, *CONFIG_WORDS]))
        return (F.length(sentence) > 0) & (sentence.rlike(DIGIT) | known)

    sentences = F.transform(F.split(text, r"\."), strip)
    return F.array_distinct(F.filter(sentences, is_claim))


def token_set(text: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    return F.array_distinct(tokens(F.lower(text)))


def overlap_keywords(claim: Column) -> Column:
    """Token set of a claim without stop words."""
    return F.filter(token_set(claim), lambda w: ~w.isin(OVERLAP_STOP_WORDS))


def is_supported(keywords: Column, evidence_tokens: Column) -> Column:
    """Some evidence token set covers at least half the keywords; no keywords need no support."""
    needed = F.size(keywords) * OVERLAP_RATIO
    covered = F.exists(
        evidence_tokens, lambda e: F.size(F.array_intersect(keywords, e)) >= needed
    )
    return (F.size(keywords) == 0) | covered


def recommendation(score: Column, ungrounded: Column, threshold: float) -> Column:
    """Advice for a grounding score (fixed texts)."""
    before, after = ADVICE_MOSTLY
    mostly = F.concat(F.lit(before), ungrounded.cast("string"), F.lit(after))
    return (
        F.when(score >= ADVICE_GOOD_FROM, ADVICE_GOOD)
        .when(score >= threshold, mostly)
        .when(score >= ADVICE_PARTLY_FROM, ADVICE_PARTLY)
        .otherwise(ADVICE_POOR)
    )
