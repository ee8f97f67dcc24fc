"""Licence scan: a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line, or a run of neighbouring lines, that holds enough words of a licence template to be confirmed by it
(``HOLDS``), and the classifier sees every one of them. No list of words decides which: of any paragraph that holds n of a template's m
words, at least one is among any m - n + 1 of them, so lines are looked up by the m - n + 1 rarest words of each template
(``anchors``), and others can't be part of a paragraph that is confirmed without one of these.

A line that is confirmed by itself is a paragraph; else the run of lines around it that holds the most of a template. Runs end at lines
without words and at lines confirmed by themselves; as lines between the ends of a template's text have no more words than the template,
longer runs aren't needed. A paragraph's words and pairs of words are joined with the weights of a sparse multinomial logistic regression
over licence families, which has a class for anything else. The weights are fitted on the driver, with an L1 penalty, from crops of the
templates below set in other words, and from sentences that only sound alike; a temperature fitted on crops kept apart calibrates
the probabilities. A family is confirmed if the paragraph holds most words of one of its templates.

Defined results: an empty table gives no rows; null and empty texts have no paragraphs; a line looked up whose best class is the unknown one, is
under ``CONFIDENT``, or isn't confirmed by a template counts as unknown; rows that repeat a doc_id count together, equal texts once, and each row is
returned; documents without doc_id are returned without findings; other columns stay out of it. The words of a text's lines are held whole, some
60 bytes for each word of the longest text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, table, written

SEPARATORS = r"[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+|\.(?![0-9])"
CONFIDENT, HOLDS = 0.5, 0.6

# Statements by which works name their licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "LGPL": ["licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "released into the public domain", "Creative Commons CC0 1.0 Universal public domain dedication"],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission."],
}
OTHER = [
    "the driver lost her license and had to renew it at the office",
    "a licence to fish in the river costs ten pounds a year",
    "he was licensed to practise medicine in three states",
    "they issued a warrant for the arrest of the two men",
    "the warranty of the machine covers two years of use",
    "copyright law protects the authors of books and songs",
    "the lecture was about copyright and patents in the music industry",
    "redistributing wealth was the main promise of the party",
    "permission is needed before you enter the building",
    "the public domain was discussed by the council of the town",
    "no license is required to keep a dog in this town",
    "the software license agreement was signed by both companies yesterday",
    "the general public was not allowed to see the version shown to the press",
    "licensed premises must close before midnight",
    "an apache helicopter landed at the base without restriction",
    "students at mit released a new robot",
]
FILLER = "the and of to in is that it for on with as this by from at are was be or have an they which one you all were her there been their has would".split()


# Frequent words of English, the most frequent first, which are the last to be taken as anchors.
COMMON = [*FILLER, *"a an i you he she we not no any all may if can do but or so its these out up about into more than other some such only new also who what when under must part free use used".split()]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def grams_of(w: list[str]) -> set[str]:
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


@lru_cache(maxsize=1)
def model(seed: int = 9, l1: float = 0.0015, rounds: int = 400):
    """(rows of gram, family, weight; bias of each family; temperature). The last family is the unknown one."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, "unknown"]

    def crop(text, least):
        w = words_of(text)
        n = rng.integers(max(1, int(np.ceil(least * len(w)))), len(w) + 1)
        a = rng.integers(0, len(w) - n + 1)
        pad = lambda: [FILLER[i] for i in rng.integers(0, len(FILLER), rng.integers(0, 12))]
        return grams_of([*pad(), *w[a : a + n], *pad()])

    def examples(n):
        x, y = [], []
        for k, f in enumerate(families):
            texts = TEMPLATES.get(f, OTHER)
            for i in range(n * (3 if f == "unknown" else 1)):
                x.append(crop(texts[i % len(texts)], 0.8))
                y.append(k)
        return x, np.array(y)

    x, y = examples(48)
    vocab = sorted(set().union(*x))
    at = {g: i for i, g in enumerate(vocab)}

    def matrix(x):
        m = np.zeros((len(x), len(vocab)))
        for r, own in enumerate(x):
            m[r, [at[g] for g in own if g in at]] = 1
        return m

    a, one = matrix(x), np.eye(len(families))[y]
    w, b, rate = np.zeros((len(vocab), len(families))), np.zeros(len(families)), 0.5
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)
    for _ in range(rounds):  # proximal gradient
        r = (soft(a @ w + b) - one) / len(a)
        w -= rate * (a.T @ r)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * r.sum(axis=0)
    x2, y2 = examples(16)
    z = matrix(x2) @ w + b
    best = min(np.linspace(0.2, 3, 57), key=lambda t: -np.log(soft(z / t)[np.arange(len(y2)), y2] + 1e-12).mean())
    rows = [(vocab[i], families[k], float(w[i, k])) for i, k in zip(*np.nonzero(np.round(w, 6)))]
    return rows, {f: float(v) for f, v in zip(families, b)}, float(best)


LONGEST = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


def words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def bound(value: str, body: str) -> str:
    """SQL of body with v for value, evaluated once; a column in a lambda may be evaluated for every element."""
    return f"get(transform(array({value}), v -> {body}), 0)"


def anchors() -> list[str]:
    """Words of which every paragraph that a template can confirm has at least one; rare and long ones first."""
    found: set[str] = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        own = sorted(set(words_of(t)), key=lambda w: (w in COMMON, -COMMON.index(w) if w in COMMON else -len(w), w))
        found |= set(own[: len(own) - math.ceil(HOLDS * len(own) - 1e-9) + 1])
    return sorted(found)


def anchored_lines(docs: DataFrame) -> DataFrame:
    """rows (doc_id, text_, start, w) of the lines that have an anchor: number and words."""
    by_first = {w[0]: [re.escape(x[1:]) for x in anchors() if x[0] == w[0]] for w in anchors()}
    near = "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(near))
    lines = lines.select("doc_id", F.xxhash64("text").alias("text_"), F.posexplode(F.split("text", "\n")).alias("start", "line"))
    rare = F.array(*[F.lit(a) for a in anchors()])
    return lines.where(F.col("line").rlike(near)).withColumn("w", words(F.col("line"))).where(F.arrays_overlap("w", rare)).drop("line").dropDuplicates(["doc_id", "text_", "start"])


def judged(runs: DataFrame) -> DataFrame:
    """runs (doc_id, text_, start, stop, w) with family, probability, holds, confirmed."""
    spark = runs.sparkSession
    weights, bias, temperature = model()
    key = ["doc_id", "text_", "start", "stop"]
    grams = F.expr("array_distinct(concat(w, transform(case when size(w) > 1 then sequence(1, size(w) - 1) else array() end, i -> concat(element_at(w, i), ' ', element_at(w, i + 1)))))")
    w = spark.createDataFrame(weights, "gram string, family string, weight double")
    met = runs.select(*key, F.explode(grams).alias("gram")).join(sized(w, 64, len(weights)), "gram")
    by = met.groupBy(*key, "family").agg(F.sum("weight").alias("s"))
    b = spark.createDataFrame(list(bias.items()), "family string, bias double")
    by = by.join(sized(b, 64, len(bias)), "family").withColumn("z", (F.col("s") + F.col("bias")) / temperature)
    rest = sum(np.exp(v / temperature) for v in bias.values())
    total = F.lit(float(rest)) + F.sum(F.exp("z") - F.exp(F.col("bias") / temperature))
    best = by.groupBy(*key).agg(F.max(F.struct("z", "family")).alias("m"), total.alias("total"))
    best = best.select(*key, F.col("m.family").alias("family"), (F.exp("m.z") / F.col("total")).alias("probability"))
    known = spark.createDataFrame([(f, sorted(set(words_of(t)))) for f, ts in TEMPLATES.items() for t in ts], "family string, template array<string>")
    known = known.groupBy("family").agg(F.collect_list("template").alias("templates"))
    out = runs.join(best, key, "left").join(sized(known, 2048, len(TEMPLATES)), "family", "left")
    holds = F.expr("coalesce(array_max(transform(templates, t -> size(array_intersect(t, w)) / size(t))), 0D)")
    out = out.withColumn("holds", holds).withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    sure = (F.col("probability") >= CONFIDENT) & (F.col("holds") >= HOLDS) & (F.col("family") != "unknown")
    return out.select(*key, F.coalesce("family", F.lit("unknown")).alias("family"), "probability", "holds", F.coalesce(sure, F.lit(False)).alias("confirmed"))


def runs_around(texts: DataFrame) -> DataFrame:
    """rows (doc_id, text_, line, start, stop, w): runs of lines around each of the lines ``open`` that may hold a template.

    Of the first and the last line only the words next to the others are taken, as many as the longest template has.
    """
    known = ", ".join(f"array({', '.join(repr(w) for w in sorted(set(words_of(t))))})" for ts in TEMPLATES.values() for t in ts)
    every = ", ".join(repr(w) for w in sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)}))
    may = lambda w: F.expr(bound(f"array_intersect({w}, array({every}))", f"exists(array({known}), t -> size(t) * {HOLDS}D <= size(v) and size(array_intersect(t, v)) / size(t) >= {HOLDS}D)"))
    run = f"concat(slice(get(lines, {{a}}), greatest(1, size(get(lines, {{a}})) - {LONGEST - 1}), {LONGEST}), flatten(slice(lines, {{a}} + 2, greatest(0, {{b}} - {{a}} - 1))), slice(get(lines, {{b}}), 1, {LONGEST}))"
    stops = "size(get(lines, j)) = 0 or array_contains(alone, j)"
    df = texts.withColumn("line", F.explode("open"))
    low, high = f"greatest(0, line - {LONGEST + 1})", f"least(size(lines) - 1, line + {LONGEST + 1})"
    df = df.withColumn("low", F.expr(f"coalesce(array_max(filter(sequence({low}, line), j -> j < line and ({stops}))) + 1, {low})"))
    df = df.withColumn("high", F.expr(f"coalesce(array_min(filter(sequence(line, {high}), j -> j > line and ({stops}))) - 1, {high})"))
    df = df.where("low < high").withColumn("lines", F.expr("slice(lines, low + 1, high - low + 1)")).withColumn("i", F.expr("line - low"))
    df = df.where(may("flatten(lines)"))
    inner = "aggregate(slice(v.l, a + 2, greatest(0, b - a - 1)), 0, (n, l) -> n + size(l))"
    pairs = bound("named_struct('l', lines, 'i', i)", f"flatten(transform(sequence(0, v.i), a -> transform(filter(sequence(v.i, size(v.l) - 1), b -> b > a and {inner} <= {LONGEST}), b -> named_struct('a', a, 'b', b))))")
    df = df.withColumn("r", F.explode(F.expr(pairs))).withColumn("w", F.expr(run.format(a="r.a", b="r.b"))).where(may("w"))
    return df.select("doc_id", "text_", "line", F.expr("low + r.a").alias("start"), F.expr("low + r.b").alias("stop"), "w")


def paragraphs(docs: DataFrame) -> DataFrame:
    """rows (doc_id, line, family, probability, holds, confirmed) of the paragraphs; line is the first of them."""
    key = ["doc_id", "text_"]
    lines = written(anchored_lines(docs), "anchored-lines")
    lines = written(judged(lines.select(*key, "start", F.col("start").alias("stop"), "w")), "lines")
    split = lines.groupBy(*key).agg(F.collect_list(F.when(F.col("confirmed"), F.col("start"))).alias("alone"), F.collect_list(F.when(~F.col("confirmed"), F.col("start"))).alias("open"))
    split = written(split.where("size(open) > 0"), "open-lines")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_")).join(sized(split.select(*key), 48), key, "left_semi").dropDuplicates(key)
    texts = texts.select(*key, F.transform(F.split("text", "\n"), words).alias("lines"))
    around = written(runs_around(texts.join(split, key)), "runs")
    runs = judged(around.select(*key, "start", "stop", "w").distinct()).where("confirmed")
    most = F.max_by(F.struct("start", "stop", "family", "probability", "holds", "confirmed"), F.struct("holds", F.expr("start - stop"), -F.col("start")))
    of_line = written(around.select(*key, "line", "start", "stop").join(runs, [*key, "start", "stop"]).groupBy(*key, "line").agg(most.alias("m")), "runs-of-lines")
    rest = lines.join(of_line.select(*key, F.col("line").alias("start")), [*key, "start"], "left_anti")
    # Runs of one family that overlap are one paragraph.
    ahead = "max(stop) over (partition by doc_id, text_, family order by start, stop rows between unbounded preceding and 1 preceding)"
    found = of_line.select(*key, "m.*").distinct().withColumn("new", F.expr(f"int(coalesce(start > {ahead}, true))"))
    found = found.withColumn("n", F.expr("sum(new) over (partition by doc_id, text_, family order by start, stop rows unbounded preceding)"))
    found = found.groupBy(*key, "family", "n").agg(F.min("start").alias("start"), F.max(F.struct("holds", "probability")).alias("m"))
    found = found.select("doc_id", "start", "family", "m.probability", "m.holds", F.lit(True).alias("confirmed"))
    out = rest.select("doc_id", "start", "family", "probability", "holds", "confirmed").union(found)
    return out.select("doc_id", F.col("start").alias("line"), "family", "probability", "holds", "confirmed")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families confirmed, sorted, comma-joined), n_confirmed, n_unknown, confidence."""
    found = paragraphs(docs).groupBy("doc_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("licences"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(~F.col("confirmed")).alias("n_unknown"),
        F.max(F.when(F.col("confirmed"), F.round("probability", 6))).alias("confidence"),
    )
    zero = F.lit(0).cast("long")
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
