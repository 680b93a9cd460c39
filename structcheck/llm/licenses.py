"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

The paragraphs of a text are its lines, and up to WINDOW wrapped lines together, from each line on: a statement that
is wrapped is found where its lines are joined. A joined paragraph is a finding only when it is confirmed, no line of
it is confirmed alone for that family, and no joined paragraph with common lines fits the family better. A multinomial logistic regression over word 1-, 2- and 3-grams gives the
probability of each licence family and of a class for everything else; it is fitted on the driver from TEMPLATES and
OTHERS, small tables of statements, in variants with words left out or put before and after. Its temperature is
calibrated on statements that a model was not fitted on, in FOLDS parts; `held_out` is the share of these that such a
model gets right. A paragraph below `least` in its best family is unknown; a prediction is
confirmed when the words of a template of that family are found in the paragraph to a share of `overlap`.

Only n-grams of the fitted vocabulary have weights. A paragraph is classified if it has one of ANCHORS or of `telling`:
for each template so many of its rarest words that a paragraph without any of them cannot hold the share `overlap`, so
what is not classified could not be confirmed. Distinct paragraphs are classified once: exploded into n-grams and joined with the
weights, a table bounded by the statements. Everything on the documents is DataFrame functions.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This software is released under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-only", "Distributed under the GNU GPL version 2 or later license."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "bsd": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This text is available under the license CC BY-SA 4.0."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "proprietary": ["Copyright. All rights reserved. No part may be reproduced without written permission.", "This software is proprietary and confidential; use is subject to a commercial license agreement."],
}
OTHERS = [
    "He lost his driving license last year.", "The council granted permission to build on the land.", "A licensed plumber came on Tuesday.", "The license plate of the car was from another state.", "Copyright law is older than most people think.", "They asked for permission to leave early.",
    "The apache helicopter landed at noon.", "She studied at MIT for three years.", "The general public was not admitted.", "The wine shop has a license until midnight.", "It was free of charge for children.", "Version 2.0 of the plan was released under pressure.", "The warranty on the machine covers two years.",
    "Public opinion on the foundation changed.", "The creative work of the commons committee was praised.", "Conditions in the source region are met with concern.", "All rights of way are marked on the map.", "The licensing board met in May.",
]
ANCHORS = r"(?i)licen[sc]e|licensed|copyright|permission|redistribut|creative commons|cc[ -]by|public license|rights reserved|proprietary|spdx"
UNKNOWN = "unknown"
WINDOW, WRAPPED = 6, 100
FOLDS = 3
#: Words that texts of any kind have; `telling` takes them last.
COMMON = frozenset("a above all and any are as be by can com event except express file files following for form free from general has have held in into is it its later law made may mit more no not of on only or out part person program provided public purpose related released rights source subject text that the them there these they this to under use version was were will with without work written you".split())


def telling(templates: dict[str, list[str]], overlap: float) -> str:
    """An expression that every paragraph with a share `overlap` of some template's words matches."""
    sets = [set(words_of(t)) for ts in templates.values() for t in ts]
    often = Counter(w for s in sets for w in s)
    picked = set()
    for s in sets:
        most_missing = len(s) - math.ceil(overlap * len(s) - 1e-9)
        picked |= set(sorted(s, key=lambda w: (w in COMMON or w.isdigit(), often[w], -len(w), w))[: most_missing + 1])
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(picked))})(?![a-z0-9])"


def words_of(text: str) -> list[str]:
    """The words of a statement, as `tokens` has them in SQL."""
    return [w for w in re.split(r"[^a-z0-9]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text)) if w]


def grams_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def variants(text: str, filler: list[str], rng: random.Random, count: int) -> list[list[str]]:
    """The words of a statement, whole and with losses and other words around it."""
    words = words_of(text)
    out = [words]
    for _ in range(count - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        out.append(rng.sample(filler, rng.randint(0, 4)) + kept + rng.sample(filler, rng.randint(0, 4)))
    return out


class Classifier:
    """Weights by family and n-gram, a bias by family, a temperature; held_out, see above."""

    def __init__(self, templates: dict[str, list[str]], others: list[str], seed: int = 7, ridge: float = 0.02, steps: int = 300):
        rng = random.Random(seed)
        filler = sorted({w for t in others for w in words_of(t)})
        self.families = [*sorted(templates), UNKNOWN]
        rows, labels, parts = [], [], []
        for i, f in enumerate(self.families):
            for j, text in enumerate(others if f == UNKNOWN else templates[f]):
                made = variants(text, filler, rng, 9)
                rows += made
                labels += [i] * len(made)
                parts += [j % FOLDS] * len(made)
        self.grams = sorted({g for r in rows for g in grams_of(r)})
        self.at = {g: i for i, g in enumerate(self.grams)}
        x, t, part = self.matrix(rows), np.array(labels), np.array(parts)
        z = np.zeros((len(rows), len(self.families)))
        for p in range(FOLDS):
            w, b = self.fitted(x[part != p], t[part != p], ridge, steps)
            z[part == p] = x[part == p] @ w + b
        loss = {temp: -np.log(self.soft(z / temp)[np.arange(len(t)), t] + 1e-12).mean() for temp in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature, self.held_out = min(loss, key=loss.get), float((z.argmax(1) == t).mean())
        self.weights, self.bias = self.fitted(x, t, ridge, steps)

    def fitted(self, x: np.ndarray, t: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
        y = np.eye(len(self.families))[t]
        w, b = np.zeros((x.shape[1], len(self.families))), np.zeros(len(self.families))
        speed = np.zeros_like(w)
        for _ in range(steps):
            p = self.soft(x @ w + b)
            speed = 0.9 * speed + (x.T @ (p - y) / len(y) + ridge / 100 * w)
            w -= 2.0 * speed
            b -= 0.5 * (p - y).mean(0)
        return w, b

    def matrix(self, rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.grams)))
        for i, r in enumerate(rows):
            x[i, [self.at[g] for g in grams_of(r) if g in self.at]] = 1.0
        return x

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def tokens(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, "[^a-z0-9]+"), "")


def classify(paragraphs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.6, overlap: float = 0.7) -> DataFrame:
    """For each row (key, paragraph): key, family, probability, overlap, confirmed. Keys are distinct.

    A paragraph below `least` is of the family ``unknown`` and not confirmed.
    """
    spark = paragraphs.sparkSession
    templates = templates or TEMPLATES
    model = Classifier(templates, OTHERS)
    some = [(g, [float(v) for v in model.weights[i]]) for i, g in enumerate(model.grams)]
    weights = F.broadcast(spark.createDataFrame(some, "gram string, w array<double>"))  # one row for each n-gram of the statements
    words = paragraphs.select("key", tokens(F.col("paragraph")).alias("words"))
    n = F.size("words")
    runs = F.concat(*[
        F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))).otherwise(F.array().cast("array<string>"))
        for k in (1, 2, 3)
    ])
    grams = words.select("key", F.explode(F.array_distinct(runs)).alias("gram"))
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(model.families))]
    scored = grams.join(weights, "gram").groupBy("key").agg(*sums)
    logits = F.array(*[(F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + float(model.bias[i])) / model.temperature for i in range(len(model.families))])
    joined = words.join(scored, "key", "left").select("key", "words", logits.alias("z"))
    top = F.array_max("z")
    shares = F.transform("z", lambda v: F.exp(v - top))
    best = joined.select("key", "words", (F.lit(1.0) / F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)).alias("probability"), F.get(F.array(*map(F.lit, model.families)), F.array_position("z", top).cast("int") - 1).alias("family"))
    texts = F.create_map(*[x for f, ts in sorted(templates.items()) for x in (F.lit(f), F.array(*[F.array(*map(F.lit, sorted(set(words_of(t))))) for t in ts]))])
    found = F.array_max(F.transform(F.element_at(texts, F.col("family")), lambda t: F.size(F.array_intersect(t, "words")) / F.size(t)))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= least)
    out = best.withColumn("family", F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)))
    out = out.withColumn("overlap", F.coalesce(found, F.lit(0.0)))
    return out.select("key", "family", "probability", "overlap", ((F.col("family") != UNKNOWN) & (F.col("overlap") >= overlap)).alias("confirmed"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: id, findings (line from 0, family, probability, overlap, confirmed), in line order.

    Every line that is classified has a finding, also an unknown one; joined lines have one, at their first, if confirmed. A null or empty text has none. Repeated rows get equal
    findings. Only the two named columns are read.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    anchors = f"{ANCHORS}|{telling(TEMPLATES, 0.7)}"
    raw = F.transform(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x: F.trim(x))
    unit_type = "array<struct<line:int,until:int,paragraph:string>>"

    def units(ls: Column) -> Column:
        def joined(i: Column) -> Column:
            w = F.slice(ls, i + 1, WINDOW)
            stop = F.array_position(F.transform(w, lambda x: ~x.rlike("[A-Za-z0-9]") | (F.char_length(x) > WRAPPED)), True).cast("int")
            n = F.when(stop > 0, stop - 1).otherwise(F.size(w))
            return F.struct(i.alias("line"), (i + n - 1).alias("until"), F.array_join(F.slice(w, 1, n), " ").alias("paragraph"))

        single = F.transform(ls, lambda x, i: F.struct(i.alias("line"), i.alias("until"), x.alias("paragraph")))
        wrapped = F.filter(F.transform(F.sequence(F.lit(0), F.size(ls) - 1), joined), lambda s: s["until"] > s["line"])
        return F.filter(F.concat(single.cast(unit_type), wrapped.cast(unit_type)), lambda s: s["paragraph"].rlike(anchors))

    lines = let(raw, units)
    gate = F.coalesce(F.col("t").rlike(anchors), F.lit(False))
    none = F.array().cast(unit_type)
    held = written(given.select("id", F.when(gate, F.xxhash64("t")).alias("text_key"), F.when(gate, F.md5("t")).alias("text_md5"), F.when(gate, lines).otherwise(none).alias("lines")), "licenses")
    empty = F.array().cast("array<struct<line:int,family:string,probability:double,overlap:double,confirmed:boolean>>")
    texts = held.filter(F.size("lines") > 0).dropDuplicates(["text_key", "text_md5"]).select("text_key", "text_md5", F.explode("lines").alias("l")).select("text_key", "text_md5", "l.line", "l.until", "l.paragraph")
    distinct = written(texts.select("paragraph").distinct().withColumn("key", F.sha2("paragraph", 256)), "paragraphs")
    classes = classify(distinct)
    found = texts.withColumn("key", F.sha2("paragraph", 256)).join(classes, "key")
    found = found.filter((F.col("line") == F.col("until")) | F.col("confirmed"))
    each = found.groupBy("text_key", "text_md5").agg(F.array_sort(F.collect_list(F.struct("line", "until", "family", "probability", "overlap", "confirmed"))).alias("all"))

    def outdone(j: Column, s: Column) -> Column:
        single = s["line"] == s["until"]
        better = (s["overlap"] > j["overlap"]) | ((s["overlap"] == j["overlap"]) & (s["line"] > j["line"]))
        return s["confirmed"] & (s["family"] == j["family"]) & (s["line"] <= j["until"]) & (j["line"] <= s["until"]) & (single | better)

    kept = F.filter("all", lambda j: (j["line"] == j["until"]) | ~F.exists("all", lambda s: outdone(j, s)))
    each = each.select("text_key", "text_md5", F.transform(kept, lambda f: f.dropFields("until")).alias("findings"))
    some = held.filter(F.size("lines") > 0).join(each, ["text_key", "text_md5"]).select("id", "findings")
    return some.unionByName(held.filter(F.size("lines") == 0).select("id", empty.alias("findings"))).select(F.col("id").alias(id_col), "findings")
