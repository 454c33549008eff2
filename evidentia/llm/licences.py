"""License scans: a positional index of rare words over licence templates.

The words of all templates are counted over every document; each template is posted under its ``ANCHORS`` rarest words
with their places. A file's words are looked up once; every hit names the starts its template would have, a start stands
if enough anchors lie at the same relative position, and the key phrases a template demands must follow as written. Base
phrases are templates that demand all of their words, so exactly their occurrences remain. Everything happens in built-in
expressions on the row of the file: nothing is joined or shuffled but the document counts of the templates' words.

Defined results: a NULL or empty text has no words, empty labels and score 0; rows that repeat are scanned alike; without
documents there is nothing to count and nothing to return; a template without words is ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import fresh, let, lower_ascii, table

#: What stands between words of a text in which A-Z still stand as they are.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ANCHORS = 3
#: Anchors that must agree on the start of a template that is not a base phrase, and words its end may drift.
AGREE, DRIFT = 2, 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    words: list[str] = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "words", [w for w in re.split(GAP, self.text.lower()) if w])


# Base phrases of the contract, and opening words of public licence notices.
BASE = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
]
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License", ("you may not use this file except in compliance",)),
    Template("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
]


def file_words(text: Column) -> Column:
    """Words of a text before A-Z are lower-cased, which leaves their number and places as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_counts(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Documents that hold each word of the templates. The result has at most as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter(F.transform(file_words(F.col("text")), lambda w: F.lower(w)), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counts.collect()}


def _anchors(template: Template, weight: dict[str, float]) -> list[tuple[int, str]]:
    """Places and words of the rarest words of a template, each at its first place."""
    rare = sorted(set(template.words), key=lambda w: (-weight[w], w))[:ANCHORS]
    return sorted((template.words.index(w), w) for w in rare)


def _literal(templates: list[Template], weight: dict[str, float]) -> Column:
    """The templates as one constant array."""
    return F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words)).alias("length"),
            F.array(*[F.struct(F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in _anchors(t, weight)]).alias("anchors"),
            F.lit(len(_anchors(t, weight)) if t.base else min(AGREE, len(set(t.words)))).alias("agree"),
            F.array(*[F.lit(k) for k in ((" ".join(t.words),) if t.base else t.keys)]).cast("array<string>").alias("keys"),
            F.array(*[F.lit(w) for w in sorted(set(t.words))]).alias("vocabulary"))
        for t in templates])


def scan_licences(docs: DataFrame, templates: list[Template] | None = None) -> tuple[DataFrame, str]:
    """Every row of ``docs`` with a struct column of the licences found; also the name of that column.

    ``matches`` has the label, the start (in words) and the score of every place: 1 for a base phrase, else the share of
    the template's words that stand there.
    """
    given = [t for t in (templates or BASE + NOTICES) if t.words]
    counts = word_counts(docs, given)
    weight = {w: 1 / (1 + n) for w, n in counts.items()}  # orders words as their inverse document frequency does
    result, words, matches = fresh(docs, "licences", "__words", "__matches")
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(given):
        for at, word in _anchors(t, weight):
            postings.setdefault(word, []).append((number, at))
    index = F.create_map(*[c for w, found in sorted(postings.items()) for c in (
        F.lit(w), F.array(*[F.struct(F.lit(n).alias("t"), F.lit(at).alias("at")) for n, at in found]))])
    known = _literal(given, weight)
    w = F.col(words)
    word_at = lambda i: lower_ascii(F.get(w, i))
    hits = F.array_compact(F.transform(w, lambda x, i: F.when(F.lower(x).isin(sorted(postings)), i)))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.transform(
        F.coalesce(F.try_element_at(index, word_at(p)), F.array().cast("array<struct<t:int,at:int>>")),
        lambda e: F.struct(e["t"].alias("t"), (p - e["at"]).alias("start"))))))

    def judged(c: Column) -> Column:
        t = F.get(known, c["t"])
        first = F.greatest(c["start"], F.lit(0))
        agreeing = F.size(F.filter(t["anchors"], lambda a: word_at(c["start"] + a["at"]).eqNullSafe(a["word"])))
        length = F.when(t["base"], t["length"]).otherwise(t["length"] + DRIFT)
        window = F.transform(F.slice(w, first + 1, length), lower_ascii)
        line = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        keyed = F.forall(t["keys"], lambda k: F.contains(line, F.concat(F.lit(" "), k, F.lit(" "))))
        share = F.size(F.array_intersect(t["vocabulary"], window)) / F.size(t["vocabulary"])
        found = F.struct(t["label"].alias("label"), t["base"].alias("base"), first.cast("long").alias("start"),
                         F.when(t["base"], F.lit(1.0)).otherwise(share).alias("score"))
        return F.when((agreeing >= t["agree"]) & keyed, found)

    found = docs.withColumn(words, file_words(F.col("text"))).withColumn(
        matches, let(starts, lambda s: F.array_compact(F.transform(s, judged))))
    m = F.col(matches)
    base_starts = F.transform(F.filter(m, lambda x: x["base"]), lambda x: x["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    scanned = found.withColumn(result, F.struct(
        F.size(words).cast("long").alias("n_words"), F.size(base_starts).cast("long").alias("n_base"),
        F.array_min(base_starts).alias("first_word"), F.array_max(base_starts).alias("last_word"),
        joined(F.transform(F.filter(m, lambda x: x["base"]), lambda x: x["label"])).alias("base_labels"),
        joined(F.transform(m, lambda x: x["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["score"])), F.lit(0.0)).alias("score"), m.alias("matches")))
    return scanned.drop(words, matches), result


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, result = scan_licences(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", *[f"{result}.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
