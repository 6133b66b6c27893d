"""Input screening and output redaction as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from opsloom.functions.text import UNICODE, UNICODE_NOCASE, contains_any, count_newlines, flag, fold, let, strip, tokens

# --- fixed values -----------------------------------------------------------
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
    r"forget\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
    r"you\s+are\s+now\s+(a|an|the)\s+",
    r"act\s+as\s+(if\s+you\s+are|a|an)\s+",
    r"pretend\s+(to\s+be|you\s+are)\s+",
    r"roleplay\s+as\s+",
    r"(show|reveal|display|print|output)\s+(me\s+)?(your|the)\s+(system\s+)?(prompt|instructions)",
    r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions)",
    r"do\s+anything\s+now",
    r"dan\s+mode",
    r"developer\s+mode",
    r"bypass\s+(the\s+)?(content\s+)?(filter|policy|restriction)",
    r"execute\s+(this\s+)?(code|command|script)",
    r"run\s+(this\s+)?(code|command|script)",
    r"eval\s*\(",
    r"exec\s*\(",
]
BLOCKED_PATTERNS = [
    r"(how\s+to\s+)?(hack|attack|exploit|compromise)\s+(a\s+)?(network|system|server)",
    r"(create|make|build)\s+(a\s+)?(malware|virus|ransomware|trojan)",
    r"(give|show|list)\s+(me\s+)?(all\s+)?(passwords|credentials|secrets|api\s*keys)",
    r"(access|dump|extract)\s+(the\s+)?(database|customer\s+data)",
]
MAX_MESSAGE_LENGTH = 10000
RISK_MARKERS = ["system:", "assistant:", "user:", "[inst]", "[/inst]", "<|", "|>", "```"]
BASE64_RUN = r"[A-Za-z0-9+/]{50,}={0,2}"
RISK_LIMIT = 0.7

PII_PATTERNS = {
    "phone_us": r"\b(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "phone_intl": r"\b\+[1-9][0-9]{7,14}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
}
PII_REPLACEMENTS = {
    "phone_us": "[PHONE REDACTED]",
    "phone_intl": "[PHONE REDACTED]",
    "email": "[EMAIL REDACTED]",
    "ipv4": "[IP REDACTED]",
    "ipv6": "[IP REDACTED]",
    "ssn": "[SSN REDACTED]",
    "credit_card": "[CARD REDACTED]",
    "mac_address": "[MAC REDACTED]",
}
CREDENTIAL_PATTERNS = [
    r"password\s*[:=]\s*\S+",
    r"api[_-]?key\s*[:=]\s*\S+",
    r"secret[_-]?key\s*[:=]\s*\S+",
    r"access[_-]?token\s*[:=]\s*\S+",
    r"bearer\s+[A-Za-z0-9._-]+",
]
CREDENTIAL_REPLACEMENT = "[CREDENTIAL REDACTED]"
#: reasons of refused messages
SAYS_INJECTION = "Potential prompt injection detected"
SAYS_BLOCKED = "Message contains blocked content"
SAYS_HARMFUL = "Message flagged as potentially harmful"
SAYS_TOO_LONG = "Message exceeds maximum length of {} characters"
# --- end of fixed values ----------------------------------------------------

#: a run is looked for at its start only, not again at each of its characters
_RUN_START = r"(?<![A-Za-z0-9+/])"
#: text that every match of a pattern contains: a plain search for it comes
#: before the pattern, so that most texts never reach the pattern
REQUIRED_WORDS = dict(
    zip(
        INJECTION_PATTERNS,
        [
            ["ignore"], ["disregard"], ["forget"], ["now"], ["act"], ["pretend"], ["roleplay"],
            ["prompt", "instructions"], ["prompt", "instructions"], ["anything"], ["dan"], ["developer"], ["bypass"],
            ["execute"], ["run"], ["eval"], ["exec"],
        ],
    )
) | dict(
    zip(
        BLOCKED_PATTERNS,
        [
            ["network", "system", "server"],
            ["malware", "virus", "ransomware", "trojan"],
            ["passwords", "credentials", "secrets", "keys"],
            ["database", "customer"],
        ],
    )
)
PII_SIGNS = {
    "phone_us": r"[0-9]{4}",
    "phone_intl": r"\+[1-9]",
    "email": r"@",
    "ipv4": r"[0-9]\.[0-9]",
    "ipv6": r"[0-9a-fA-F]:[0-9a-fA-F]",
    "ssn": r"[0-9]-[0-9]",
    "credit_card": r"[0-9]{13}",
    "mac_address": r"[0-9A-Fa-f][:-][0-9A-Fa-f]",
}
CREDENTIAL_WORDS = ["password", "api", "secret", "access", "bearer"]


def any_pattern(folded: Column, patterns: Sequence[str]) -> Column:
    """Search for any of the patterns in a folded text (see :func:`fold`)."""
    found = F.lit(False)
    for pattern in patterns:
        if pattern in REQUIRED_WORDS:
            hit = contains_any(folded, REQUIRED_WORDS[pattern]) & folded.rlike(UNICODE + pattern)
        else:
            hit = folded.rlike(UNICODE_NOCASE + pattern)
        found = found | hit
    return found


def risk_score(message: Column) -> Column:
    """Additive risk of a message, at most 1."""
    special = F.regexp_count(message, F.lit(r"[^\p{L}\p{N}\s\x0B\x1C-\x1F\x85\p{Z}]"))
    newlines = count_newlines(message)
    score = flag(special > F.length(message) * 0.3) * 0.2 + flag(newlines > 20) * 0.15

    def from_words(lowered: Column) -> Column:
        def repetitive(words: Column) -> Column:
            return F.try_divide(F.size(F.array_distinct(words)), F.size(words)) < 0.3

        total = score + flag(let(tokens(lowered), repetitive)) * 0.2
        for marker in RISK_MARKERS:
            total = total + flag(lowered.contains(marker)) * 0.1
        return total

    score = let(F.lower(message), from_words) + flag(message.rlike(_RUN_START + BASE64_RUN)) * 0.15
    return F.least(score, F.lit(1.0))


def validate_input(
    message: Column,
    max_length: int = MAX_MESSAGE_LENGTH,
    injection_patterns: Sequence[str] = tuple(INJECTION_PATTERNS),
    blocked_patterns: Sequence[str] = tuple(BLOCKED_PATTERNS),
) -> Column:
    """``struct<is_safe, reason, risk_score>``; the first failing check decides.

    Cheap checks come first in one ``CASE``, so a row stops at its verdict and
    the risk score is computed once, only where no earlier check failed.
    """

    def verdict(reason: str | None, risk: float | Column) -> Column:
        score = risk if isinstance(risk, Column) else F.lit(risk)
        return F.struct(
            F.lit(reason is None).alias("is_safe"),
            F.lit(reason).cast("string").alias("reason"),
            score.cast("double").alias("risk_score"),
        )

    def by_risk(risk: Column) -> Column:
        flagged = verdict(SAYS_HARMFUL, risk)
        return F.when(risk > RISK_LIMIT, flagged).otherwise(verdict(None, risk))

    def by_content(folded: Column) -> Column:
        return (
            F.when(any_pattern(folded, injection_patterns), verdict(SAYS_INJECTION, 0.9))
            .when(any_pattern(folded, blocked_patterns), verdict(SAYS_BLOCKED, 0.8))
            .otherwise(let(risk_score(message), by_risk))
        )

    too_long = SAYS_TOO_LONG.format(max_length)
    return (
        F.when(message.isNull() | (F.length(message) == 0), verdict(None, 0.0))
        .when(F.length(message) > max_length, verdict(too_long, 0.3))
        .otherwise(let(fold(message), by_content))
    )


def sanitize(message: Column, max_length: int = MAX_MESSAGE_LENGTH) -> Column:
    """Cut, squeeze blank runs, drop non-printing characters, trim - in that order."""
    cut = F.substring(message, 1, max_length)
    squeezed = F.regexp_replace(F.regexp_replace(cut, r"\n{3,}", "\n\n"), r" {3,}", "  ")
    printable = F.regexp_replace(squeezed, r"[\p{C}\p{Z}&&[^\n\t ]]", "")
    return strip(printable)


def redact_pii(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """Replace personal data only (used for source references)."""
    for name, pattern in {**PII_PATTERNS, **(patterns or {})}.items():
        text = let(text, _replacing(name, pattern))
    return text


def _replacing(name: str, pattern: str) -> Callable[[Column], Column]:
    def apply(t: Column) -> Column:
        return F.when(_sign(t, name), F.regexp_replace(t, UNICODE + pattern, replacement_for(name))).otherwise(t)

    return apply


def _sign(text: Column, name: str) -> Column:
    """Cheap test that a text may hold personal data of a kind."""
    return text.rlike(PII_SIGNS[name]) if name in PII_SIGNS else F.lit(True)


def redact_sources(sources: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """:func:`redact_pii` over an array of source references."""
    return F.transform(sources, lambda s: redact_pii(s, patterns))


def replacement_for(name: str) -> str:
    """The marker that replaces a kind of personal data (custom kinds get their own)."""
    return PII_REPLACEMENTS.get(name, f"[{name.upper()} REDACTED]")


def pii_counts(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """``map<type, count>`` of personal data on the raw text; absent types left out."""
    entries = [
        F.struct(
            F.lit(name).alias("k"),
            F.when(_sign(text, name), F.regexp_count(text, F.lit(UNICODE + pattern))).otherwise(0).alias("v"),
        )
        for name, pattern in {**PII_PATTERNS, **(patterns or {})}.items()
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] > 0))


def redact_output(
    text: Column,
    filter_pii: bool = True,
    filter_credentials: bool = True,
    custom_patterns: Mapping[str, str] | None = None,
) -> Column:
    """``struct<text, pii_removed, filtered_types>`` of a response.

    Kinds are handled one after the other, each on the text the previous one
    left, so a later kind cannot match what an earlier one replaced.  Each
    step searches first: a text without matches is scanned once per kind and
    never rebuilt.
    """
    # markers hold no digits, signs or credential words, so those can be
    # looked for in the original text as well as in the current one
    given = F.coalesce(text, F.lit(""))
    stages: list[tuple[str, str, str, Callable[[Column], Column]]] = []
    if filter_pii:
        for name, pattern in {**PII_PATTERNS, **(custom_patterns or {})}.items():
            stages.append((name, UNICODE + pattern, replacement_for(name), lambda t, low, n=name: _sign(t, n)))
    if filter_credentials:
        for pattern, word in zip(CREDENTIAL_PATTERNS, CREDENTIAL_WORDS):
            stages.append(
                ("credential", UNICODE_NOCASE + pattern, CREDENTIAL_REPLACEMENT, lambda t, low, w=word: low.contains(w))
            )

    def stage(name: str, pattern: str, marker: str, possible, low: Column) -> Callable[[Column], Column]:
        def apply(state: Column) -> Column:
            t = state["text"]
            replaced = F.struct(
                F.regexp_replace(t, pattern, marker).alias("text"),
                (state["pii_removed"] + F.regexp_count(t, F.lit(pattern))).alias("pii_removed"),
                F.array_union(state["filtered_types"], F.array(F.lit(name))).alias("filtered_types"),
            ).cast(_REDACTED)
            return F.when(possible(t, low) & t.rlike(pattern), replaced).otherwise(state)

        return apply

    def run(low: Column) -> Column:
        state = F.struct(
            given.alias("text"),
            F.lit(0).alias("pii_removed"),
            F.array().cast("array<string>").alias("filtered_types"),
        ).cast(_REDACTED)
        for name, pattern, marker, possible in stages:
            state = let(state, stage(name, pattern, marker, possible, low))
        return state

    return let(fold(given), run)


_REDACTED = "struct<text:string,pii_removed:int,filtered_types:array<string>>"


def is_acceptable_request(message: Column) -> Column:
    """Length of a chat message is within 1..4000 characters."""
    return F.length(message).between(1, 4000)


def is_acceptable_score(score: Column) -> Column:
    """A score lies within 0..1."""
    return score.between(0.0, 1.0)
