"""Small awkward tables for the corpus operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, size string, version string, score string"

LONG = "\n".join(f"line number {i} of a very long text that nobody else has" for i in range(3000))


def rows():
    shared = "  This passage is shared by many DOCUMENTS of the corpus. "
    base = [
        (1, "The first text.\n" + shared + "\nIt ends here.", "en", "a"),
        (2, shared.lower() + "\nAnother text altogether, with words.", "en", "a"),
        (3, "Nothing in common.\n" + shared + "\n" + shared, "en", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \t\n\x0b ", "en", None),
        (7, "7 + 8 = 15 !!", None, "c"),
        (8, LONG, "en", "a"),
        (9, "Ein kurzer Satz mit Umlauten: äöü ÄÖÜ.", "de", "c"),
        (10, "Ein kurzer Satz mit Umlauten: äöü ÄÖÜ.", "de", "c"),
        (10, "Ein kurzer Satz mit Umlauten: äöü ÄÖÜ.", "de", "c"),
        (11, "same id, one text of its own", "en", "d"),
        (11, "same id, another text of its own", "en", "d"),
        (None, "a document without an id but with words", "en", "d"),
        (None, shared, None, "d"),
        (12, "one", "en", "e"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "r", "s", "v", "x") for i, t, lang, source in base]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, *rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], schema)
