"""Licence scans: TF-IDF cosine of header windows with notice templates, then inheritance from licence files (DataFrame operations only)."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.text import let
from opsloom.llm.shared import ascii_lower
from opsloom.session import cut_lineage

#: fixed values: licence id and the notice by which it is known
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

LEAST = 0.75
#: adjacent lines or sentences that a notice may be wrapped over
WINDOW = 6
_GAP = "[^a-z0-9]+"
#: ends of a line or sentence
_UNIT_END = r"(?<=[.!?])[\x20\x09-\x0D]+|\n"
#: names of files that license their directory
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(_GAP, text.translate({c: c + 32 for c in range(65, 91)})) if t]


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template term occurs (at most one row per term)."""
    words = F.array_intersect(_tokens(F.coalesce("text", F.lit(""))), F.array(*[F.lit(t) for t in terms]))
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    return docs.count(), {r["term"]: r["n"] for r in counts}


class Weights:
    """TF-IDF of the templates over a corpus: inverse frequencies, norms and the terms no match can lack."""

    def __init__(self, n: int, frequencies: dict[str, int], templates: list[tuple[str, str]], least: float):
        self.bags = [Counter(tokens_of(text)) for _, text in templates]
        self.names = [name for name, _ in templates]
        terms = sorted(set().union(*self.bags))
        self.idf = {t: math.log((1 + n) / (1 + frequencies.get(t, 0))) + 1.0 for t in terms}
        #: of any word no template has
        self.other = math.log(1 + n) + 1.0
        self.norms = [math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in bag.items())) for bag in self.bags]
        self.needed = sorted(set().union(*(self._prefix(bag, norm, least) for bag, norm in zip(self.bags, self.norms))))

    def _prefix(self, bag: Counter, norm: float, least: float) -> set[str]:
        """Terms of which a line must hold one to reach the threshold.

        The others together are shorter than ``least`` times the template, so
        by Cauchy-Schwarz they cannot reach it alone.
        """
        by_weight = sorted(bag, key=lambda t: (bag[t] * self.idf[t], t))
        rest, needed = 0.0, set(bag)
        for term in by_weight:
            rest += (bag[term] * self.idf[term]) ** 2
            if math.sqrt(rest) >= least * norm * (1 - 1e-9):
                break
            needed.discard(term)
        return needed


def _runs_with(units: Column, needs: str, window: int) -> Column:
    """Runs of up to ``window`` units of which one holds a needed term: ``array<struct<line, units, __line>>``.

    Only runs around such units are formed, so a long text without them costs nothing more.
    """
    n = F.size(units)
    at = F.filter(F.transform(units, lambda u, i: F.when(u.rlike(needs), i)), lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        runs = []
        for k in range(1, window + 1):
            for back in range(k):
                inside = (i >= back) & (i - back + k <= n)
                # one number for start and length: numbers are made distinct by hash, structs pair by pair
                runs.append(F.when(inside, (i - back).cast("long") * (window + 1) + k))
        return F.filter(F.array(*runs), lambda r: r.isNotNull())

    runs = F.array_distinct(F.flatten(F.transform(at, around)))

    def run(r: Column) -> Column:
        line, length = F.floor(r / (window + 1)).cast("int"), (r % (window + 1)).cast("int")
        return F.struct(line.alias("line"), length.alias("units"), F.array_join(F.slice(units, line + 1, length), " ").alias("__line"))

    return F.transform(runs, run)


def header_matches(docs: DataFrame, least: float = LEAST, templates: list[tuple[str, str]] = TEMPLATES, window: int = WINDOW) -> DataFrame:
    """The best matching template of each document: ``doc_id, version, license, score, line, units``.

    The whole text is cut into lines and sentences; every run of one to
    ``window`` of them is compared, so notices wrapped over lines (comment
    marks are no words) or standing inside a line are found.  Weights are
    ``count * idf`` with ``idf = ln((1 + N) / (1 + df)) + 1`` over all
    documents; words outside the templates weigh as if seen nowhere.  Runs
    lacking every term a match needs are left out before they are formed,
    which drops no match.  Of equal scores the smaller licence id, then the
    earlier start (``line``, from 0), then the shorter run (``units``) counts.
    """
    terms = sorted({t for _, text in templates for t in tokens_of(text)})
    weights = Weights(*document_frequencies(docs, terms), templates, least)
    spark = docs.sparkSession
    needs = rf"(^|[^a-z0-9])({'|'.join(weights.needed)})($|[^a-z0-9])"
    text = ascii_lower(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("__text")).where(F.col("__text").rlike(needs))
    # bound once and exploded in the outer form: a filter inferred from the array's size would form it anew for each run
    runs = let(F.split("__text", _UNIT_END, -1), lambda units: _runs_with(units, needs, window))
    rows = rows.select("doc_id", F.xxhash64("__text").alias("version"), F.explode_outer(runs).alias("r"))
    rows = rows.select("doc_id", "version", "r.*").where(F.col("line").isNotNull())
    place = ["doc_id", "version", "line", "units"]
    counted = (
        rows.select(*place, F.explode(F.array_remove(F.split("__line", _GAP), "")).alias("term"))
        .groupBy(*place, "term")
        .agg(F.count("*").alias("tf"))
    )
    idf = spark.createDataFrame(list(weights.idf.items()), "term string, idf double")
    postings = [(t, i, name, c * weights.idf[t] / norm) for i, (name, bag, norm) in enumerate(zip(weights.names, weights.bags, weights.norms)) for t, c in bag.items()]
    posting = spark.createDataFrame(postings, "term string, template int, license string, share double")
    # both have a row for each template term at most
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(weights.other)))
    norm = weighed.groupBy(*place).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(posting), "term").groupBy(*place, "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in place]
    scored = dots.alias("d").join(norm.alias("n"), same).select(*[F.col(f"d.{c}") for c in place], "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license", "line", "units")).alias("b")
    found = scored.where(F.col("score") >= least).groupBy("doc_id", "version").agg(best)
    return found.select("doc_id", "version", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), "b.line", "b.units")


def _directory(path: Column) -> Column:
    """The folder of a path; empty for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(docs: DataFrame, path: Column, least: float = LEAST, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The licence of each document: ``doc_id, path, license, score, licensed_by, from_dir``.

    ``licensed_by`` is ``header`` for a notice in the document itself,
    ``directory`` for one inherited from a licence file of the nearest folder
    above (its own folder first), ``none`` otherwise (licence null).  A folder
    with several licence files takes the one with the best score, then the
    smallest id.  Folders, not documents, are joined with their ancestors, so
    the work grows with the number of folders times their depth.

    Null and empty texts match nothing; a null path lies in the top folder;
    repeated rows stay, each with the same answer; a null ``doc_id`` is an id
    like any other; an empty table gives no rows.
    """
    found = cut_lineage(header_matches(docs, least, templates), "license-headers")
    version = F.xxhash64(ascii_lower(F.coalesce("text", F.lit(""))))
    files = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), version.alias("__version"))
    own = found.select(F.col("doc_id").alias("__id"), F.col("version").alias("__own"), "license", "score")
    files = files.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__own")), "left")
    files = cut_lineage(files.select("doc_id", "path", _directory(F.col("path")).alias("dir"), "license", "score"), "license-files")

    licensing = files.where(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")
    folders = licensing.groupBy("dir").agg(best).select(F.col("dir").alias("above"), F.col("b.license").alias("given"), (-F.col("b.minus")).alias("given_score"))

    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "above"))
    nearest = F.max(F.struct("depth", "above", "given", "given_score")).alias("n")
    inherited = cut_lineage(up.join(folders, "above").groupBy("dir").agg(nearest), "license-folders")

    joined = files.join(inherited, "dir", "left")
    has_own, has_above = F.col("license").isNotNull(), F.col("n").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "n.given").alias("license"),
        F.coalesce("score", "n.given_score").alias("score"),
        F.when(has_own, "header").when(has_above, "directory").otherwise("none").alias("licensed_by"),
        F.when(~has_own, F.col("n.above")).alias("from_dir"),
    )
