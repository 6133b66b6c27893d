"""Licence scan against term weights computed one by one."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

import corpora
from opsloom.llm import licenses


def brute_scores(texts, templates, least):
    cut = licenses.tokens_of
    n, df = len(texts), Counter()
    for t in texts:
        df.update(set(cut(t or "")))
    vocabulary = {w for _, t in templates for w in cut(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in vocabulary else 0))) + 1
    norm = lambda bag: math.sqrt(sum((c * idf(w)) ** 2 for w, c in bag.items()))
    notices = [(name, Counter(cut(notice))) for name, notice in templates]
    notices = [(name, bag, norm(bag)) for name, bag in notices]
    out = []
    for t in texts:
        best = []
        units = [cut(u) for u in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n", t or "")]
        for start, k in ((i, k) for i in range(len(units)) for k in range(1, min(licenses.WINDOW, len(units) - i) + 1)):
            bag = Counter(w for unit in units[start : start + k] for w in unit)
            length = None
            for name, other, size in notices:
                dot = sum(c * bag[w] * idf(w) ** 2 for w, c in other.items() if w in bag)
                if not dot:
                    continue
                length = length or norm(bag)
                score = round(dot / length / size, 9)
                if score >= least:
                    best.append((-score, name))
        out.append((min(best)[1], -min(best)[0]) if best else None)
    return out


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/x.txt", "nothing here\nbut words"),
    (3, "a/b/x.txt", "of no account"),
    (4, "a/b/c/x.txt", "Header\n  licensed under the APACHE license, version 2.0  \nmore"),
    (5, "a/b/c/y.txt", None),
    (6, "d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (7, "d/license.md", "Released under the MIT License (MIT)."),
    (8, "d/e/x", "the license of this is a matter of its own"),
    (9, "x", ""),
    (10, "NOTICE", "Licensed under CC BY-NC 4.0."),
    (11, None, "no path"),
    (12, "a/LICENSES", "no licence in it, so nothing to give"),
    (12, "a/b/LICENSE.txt", "no licence in it either"),
    (None, "d/f/z", "words"),
    (13, "ab/x", "beside a, not below it"),
]


def inherit(scores):
    folder = lambda p: "/".join((p or "").split("/")[:-1])
    given = {}
    for (_, path, _), own in zip(FILES, scores):
        if own and re.search(licenses.LICENSE_FILE, path or ""):
            at = folder(path)
            given[at] = min(given.get(at, (1, "")), (-own[1], own[0]))
    out = []
    for (doc_id, path, _), own in zip(FILES, scores):
        if own:
            out.append((doc_id, path or "", own[0], own[1], "header", None))
            continue
        parts = folder(path).split("/") if folder(path) else []
        above = ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]
        hit = next((a for a in above if a in given), None)
        out.append((doc_id, path or "", *((given[hit][1], -given[hit][0], "directory", hit) if hit is not None else (None, None, "none", None))))
    return sorted(out, key=str)


def test_files_and_folders(spark):
    docs = spark.createDataFrame([(i, p, t, "x", 1) for i, p, t in FILES], "doc_id long, path string, text string, license string, line int")
    scores = brute_scores([t for _, _, t in FILES], licenses.TEMPLATES, licenses.LEAST)
    assert sum(s is not None for s in scores) >= 5
    out = licenses.license_scan(docs, F.col("path")).collect()
    assert sorted(map(tuple, out), key=str) == inherit(scores)


def test_prefix_terms_lose_no_match(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for least in (0.4, 0.75):
        want = brute_scores([r.text for r in rows], licenses.TEMPLATES, least)
        got = {r.doc_id: (r.license, r.score) for r in licenses.header_matches(docs, least).collect()}
        assert got == {r.doc_id: w for r, w in zip(rows, want) if w}


def test_awkward_rows(spark):
    docs = corpora.documents(spark)
    out = licenses.license_scan(docs, F.concat_ws("/", "source", "doc_id")).collect()
    assert len(out) == len(corpora.rows()) and all(r.licensed_by == "none" for r in out)
    assert licenses.license_scan(corpora.no_documents(spark), F.col("source")).collect() == []


def test_wrapped_and_inline_notices(spark):
    texts = {
        1: "The trees were tall and the river ran on. Released under the MIT License. More text follows here.",
        2: "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n#\n# code",
        3: "// This work is licensed under the GNU General\n// Public License, version 3.\nint main() { return 0; }",
        4: "Released\nunder\nthe\nMIT\nLicense.\n",
        5: "Nothing about it at all. The license of mit is under the table.\nReleased water.",
    }
    fill = [(100 + i, f"words of {i} and nothing else of the kind\n" * 3) for i in range(60)]
    docs = spark.createDataFrame([*texts.items(), *fill], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.header_matches(docs).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: "BSD-3-Clause", 3: "GPL-3.0", 4: "MIT"}
    assert (got[1].line, got[1].units) == (1, 1) and (got[2].line, got[2].units) == (0, 3) and got[3].score > 0.999


def test_a_very_long_text(spark):
    text = "quiet brook\n" * 20_000 + "word of mouth\n" * 2000 + "released under\nthe mit license.\n" + "quiet brook\n" * 20_000
    docs = spark.createDataFrame([(1, text), (2, "other words")] + [(i, f"more {i}") for i in range(3, 40)], "doc_id long, text string")
    (hit,) = licenses.header_matches(docs).collect()
    assert (hit.doc_id, hit.license, hit.line, hit.units) == (1, "MIT", 22_000, 2)
