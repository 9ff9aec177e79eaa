"""Licence families of paragraphs by a trained sparse classifier, on Spark's own functions (operator 4)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the families name themselves, and sentences of their published notices.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT licence", "Expat License", "SPDX MIT License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPL v3", "GPL-3.0", "GPLv2", "GPLv3", "GPL"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU LGPL", "LGPL-2.1", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License - v 2.0", "EPL-2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons CC0", "CC0 public domain dedication", "Creative Commons Zero license"],
    "proprietary": ["All rights reserved", "Copyright, all rights reserved", "proprietary and confidential license", "Copyright 2020 all rights reserved worldwide"],
}
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Released under the MIT License.", "Released under MIT.", "Licensed under MIT.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder."],
}
LEADS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This file is available under the {}.", "License: {}", "{}", "Published under {} by the authors.", "See {} for details."]
# Sentences that speak of licences, rights or commons but name no family.
UNKNOWN = [
    "She renewed her driving license last week.", "The licensed physician signed the form.", "A fishing licence is required on this lake.", "The licence was revoked by the court.", "License plates are made of metal.",
    "Licensed under an agreement between the parties.", "Released under licence to the broadcaster.", "See the license file for details.", "This work is licensed.", "Licensing fees apply to commercial use.", "Distributed under a custom license of the vendor.",
    "They reserved a table for two.", "The rights of all citizens are protected.", "Seats are reserved for members.", "The house of commons voted.", "Creative people work on common ground.", "He filed a copyright claim.", "Copyright law changed that year.",
    "The apache helicopter landed.", "The eclipse was seen in public.", "The public domain of the river.", "The warranty covers two years.", "Permission to enter was given.", "The attribution of the painting is contested.", "All seats reserved.", "A general public meeting was held under the mozilla tree.",
    "He sat in the software department.", "A review of this software appeared.", "This software and its rivals were compared.", "The software to be tested.", "Eclipse public viewing starts at noon.", "The permission notice hung on the door.",
    "Version 2.0 of the plan was released under pressure.", "The terms of the public contract, version 3.",
]
CUES = "licence licences licenced license licenses licensed licensing sublicense unlicense copyright copyleft reserved gnu gpl gplv2 gplv3 lgpl agpl apache bsd mozilla mpl eclipse epl expat creative commons cc cc0 spdx warranties redistribution redistributions redistribute proprietary permission attribution noncommercial sharealike waived reproduced software mit".split()
#: Words too common in some language to be a cue alone ("mit" is German, "software" is everywhere): they count beside another
#: word that is not in COMMON, or among three.
WEAK = frozenset({"mit", "software", "permission", "creative", "eclipse"})
COMMON = frozenset("a all and any for in is of on or that the this to was with".split())
ORDERS = (1, 2, 3)
#: Names of licences that belong to no family here, made from invented ones, and how such names are built: what speaks of
#: licences in general thereby speaks for none.
OTHERS = "Quartz Harbour Meadow Falcon Zenit Orbit Juniper Basalt Lantern Cobalt Tundra Saffron".split()
SHAPES = ["{} License", "{} Licence", "{} Public License", "{} Public Licence", "{} Software License", "{} Open License", "{} Free Licence, version 1.1", "{} General License", "{} Source License v2", "{} Commons License", "{}-1.0", "{}-2.0", "{} license agreement"]
#: Folds of texts and families for calibration, steps of the training, and the weight of names and notices that stand alone.
FOLDS, STEPS, ALONE = 4, 800, 20
#: Where a paragraph ends: at an empty line, or where a line ends with a sentence. So a wrapped notice is one paragraph.
BREAK = r"\n[ \t\r]*\n\s*|(?<=[.!?:;])[ \t\r]*\n"
#: Share of a template's word pairs (or of the paragraph's) that the other must have for a prediction to be confirmed.
CONFIRM = 0.6


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str], orders=ORDERS) -> set[str]:
    return {" ".join(words[i : i + n]) for n in orders for i in range(len(words) - n + 1)}


def _is_feature(gram: str) -> bool:
    words = gram.split()
    return any(w in _STRONG for w in words) or (any(w in WEAK for w in words) and (len(words) > 2 or (len(words) == 2 and not COMMON & set(words))))


_STRONG = frozenset(c for c in CUES if c not in WEAK)


def _cue_pattern() -> str:
    """Matches what holds a feature of the families' training texts: a cue word, or such words about a weak one."""
    texts = [lead.format(name) for names in NAMES.values() for name in names for lead in LEADS] + [n for notices in NOTICES.values() for n in notices]
    grams = {g for t in texts for g in grams_of(words_of(t), (2, 3)) if _is_feature(g) and not _STRONG & set(g.split())}
    grams = {g for g in grams if not any(h != g and f" {h} " in f" {g} " for h in grams)}  # a longer one holds what is there
    follow: dict[str, list[str]] = {}
    for first, *rest in map(str.split, sorted(grams)):
        follow.setdefault(first, []).append("[^A-Za-z0-9]+".join(rest))
    cues = sorted(_STRONG) + [first + "[^A-Za-z0-9]+(?:" + "|".join(rests) + ")" for first, rests in follow.items()]
    return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(cues) + r")(?![A-Za-z0-9])"


CUE_PATTERN = _cue_pattern()


@dataclass
class Classifier:
    families: list[str]  # the last is the unknown class
    weights: dict[str, list[float]]
    bias: list[float]


def training_rows() -> list[tuple[str, str]]:
    """Different texts and their families: notices, names in sentences, and sentences and made-up licences of no family."""
    rows = [(lead.format(name), f) for f, names in NAMES.items() for name in names for lead in LEADS]
    rows += [(n, f) for f, notices in NOTICES.items() for n in notices]
    rows += [(LEADS[(i + k) % len(LEADS)].format(shape.format(name)), "unknown") for i, name in enumerate(OTHERS) for k, shape in enumerate(SHAPES)]
    return list(dict.fromkeys([*rows, *((u, "unknown") for u in UNKNOWN)]))


class _Rows:
    """Texts as sparse rows of features: the memory is that of the features that the texts have."""

    def __init__(self, texts: list[str]):
        grams = [sorted(g for g in grams_of(words_of(t)) if _is_feature(g)) for t in texts]
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for gs in grams for g in gs}))}
        self.row = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        self.column = np.array([self.vocabulary[g] for gs in grams for g in gs], np.int64)
        self.n = len(texts)

    def scores(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[self.column, k], self.n) for k in range(w.shape[1])], axis=1) + b

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.column, g[self.row, k], len(self.vocabulary)) for k in range(g.shape[1])], axis=1)


def _fit(x: _Rows, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent on rows that weigh ``at``; families weigh alike."""
    w, b = np.zeros((len(x.vocabulary), y.shape[1])), np.zeros(y.shape[1])
    total = (y * at[:, None]).sum(axis=0)
    each = (y @ (1 / np.maximum(total, 1)) * at)[:, None] / (total > 0).sum()
    step, drift = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        z = x.scores(w, b)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) * each
        step = 0.9 * step - 16.0 * (x.gradient(g) + 2e-5 * w)  # with momentum
        drift = 0.9 * drift - 1.0 * g.sum(axis=0)
        w, b = w + step, b + drift
    return w, b


@lru_cache(maxsize=1)
def train() -> Classifier:
    """Softmax regression over sparse word n-grams of the notices; then one scale and a bias of the unknown class.

    These two are fitted on rows that were not trained on. In each fold some texts are left out, and some families with all
    their rows, which then are licences of no family and count as unknown.
    """
    rows, families = training_rows(), [*NAMES, "unknown"]
    x = _Rows([t for t, _ in rows])
    label = np.array([families.index(f) for _, f in rows])
    y, last = np.eye(len(families))[label], len(families) - 1
    fold = np.array([crc32(t.encode()) % FOLDS for t, _ in rows])
    alone = {n for texts in (*NAMES.values(), *NOTICES.values()) for n in texts}
    weight = np.array([ALONE if t in alone else 1 for t, _ in rows])  # what a family is known by weighs more than what was made of it
    scores, truth = [], []
    for k in range(FOLDS):
        absent = (label % FOLDS == k) & (label != last)
        w, b = _fit(x, y, weight * ((fold != k) & ~absent))
        judged = (fold == k) | absent
        z = x.scores(w, b)[judged]
        z[:, [f for f in range(last) if f % FOLDS == k]] = -30.0  # families that this fold has never seen
        scores.append(z)
        truth.append(np.where(absent, last, label)[judged])
    z, t = np.concatenate(scores), np.concatenate(truth)
    share = np.where(t == last, 0.5 / (t == last).sum(), 0.5 / (t != last).sum())

    def loss(scale, shift):
        q = scale * z + shift * np.eye(len(families))[-1]
        return float(((np.logaddexp.reduce(q, axis=1) - q[np.arange(len(t)), t]) * share).sum())

    scale, shift = min(((a, c) for a in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for c in np.arange(-2, 6.5, 0.5)), key=lambda p: loss(*p))
    w, b = _fit(x, y, weight)
    w, b = w * scale, b * scale
    b[-1] += shift
    return Classifier(families, {g: w[i].tolist() for g, i in x.vocabulary.items()}, b.tolist())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, paragraph (its number in the text, from 0), text of the paragraphs that hold a cue.

    Every feature that speaks for a family holds a cue, so a paragraph without one could only be unknown and needs no scoring.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(CUE_PATTERN))
    parts = texts.select("doc_id", F.posexplode(F.split("text", BREAK)).alias("paragraph", "line")).where(F.col("line").rlike(CUE_PATTERN))
    return parts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "paragraph", "line")


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of every paragraph that speaks of licences.

    A paragraph ends at an empty line or where a line ends with a sentence (BREAK), so a notice may be wrapped. Its word
    n-grams meet the classifier's weights in a broadcast join (as large as the published notices, whatever the corpus); sums
    become probabilities of the families and of the unknown class; the family with the highest is predicted, and confirmed if
    a template of that family shares CONFIRM of its word pairs with the paragraph. Licences of other families are unknown,
    and unknown paragraphs are returned as such, never confirmed.

    Null and empty texts have no paragraphs; repeated documents are each reported; a null key stays null; ties go to the
    first family by name; extra columns are ignored; an empty table gives no rows. All work is on Spark's own functions;
    rows of one paragraph are summed before they are shuffled, so no document, line or source gathers in one task.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs)
    classifier = classifier or train()
    k = len(classifier.families)
    weights = spark.createDataFrame([("", *classifier.bias), *((g, *w) for g, w in classifier.weights.items())], "gram string, " + ", ".join(f"w{i} double" for i in range(k)))

    cut = lines.withColumn("words", _words(F.col("line")))
    # the empty gram has the bias, so a line without a feature has a row too
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("words"), n) for n in ORDERS]))
    hits = cut.select("row", "doc_id", "paragraph", "words", F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram")
    sums = hits.groupBy("row", "doc_id", "paragraph").agg(F.first("words").alias("words"), *[F.sum(f"w{i}").alias(f"z{i}") for i in range(k)])
    scores = F.array(*[F.struct(F.col(f"z{i}").alias("z"), F.lit(-i).alias("i")) for i in range(k)])
    best = sums.withColumn("best", F.array_max(scores))
    total = sum((F.exp(F.col(f"z{i}") - F.col("best.z")) for i in range(1, k)), F.exp(F.col("z0") - F.col("best.z")))
    names = F.array(*[F.lit(f) for f in classifier.families])
    scored = best.select("doc_id", "paragraph", F.element_at(names, 1 - F.col("best.i")).alias("family"), (1 / total).alias("probability"), _grams(F.col("words"), 2).alias("pairs"))

    # a template of one word pair compares by it; families have a handful of templates, so they are literals
    cases = [F.when(F.col("family") == f, F.greatest(*[_similarity(F.col("pairs"), t) for t in (*NAMES[f], *NOTICES[f])], F.lit(0.0))) for f in NAMES]
    similarity = F.coalesce(*cases, F.lit(0.0))
    return scored.withColumn("similarity", similarity).withColumn("confirmed", (F.col("family") != "unknown") & (F.col("similarity") >= CONFIRM)).drop("pairs")


def _similarity(pairs: Column, template: str) -> Column:
    """The larger share of common word pairs: of the template's, or of the paragraph's."""
    own = sorted(grams_of(words_of(template), (2,)) or {" "})
    both = F.size(F.array_intersect(pairs, F.array(*[F.lit(p) for p in own])))
    return F.greatest(both / F.lit(len(own)), F.when(F.size(pairs) >= 3, both / F.size(F.array_distinct(pairs))).otherwise(F.lit(0.0)))
