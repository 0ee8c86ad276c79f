"""Licence scans by a trained paragraph classifier.

A sparse logistic regression over word n-grams tells which licence family a paragraph states, or none (the class
unknown). It is trained here, on variants of the licence statements below, on sentences made of the names of licences
and of ways to state one, and on paragraphs that state no licence: those of a sample, sentences that mention a name only,
and statements of other licences. Probabilities are calibrated on variants and on whole ways of stating that the weights
have not seen. A prediction is confirmed if the paragraph holds enough of the n-grams of one of its family's statements,
or the whole of one of its marks: a name that is no other word, or a short name beside a word that says licence.

Scanning takes DataFrame functions only: paragraphs without any of the words that it takes to lift a family above unknown are
passed over, the n-grams of the others are joined to the weights and summed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import least_by_hash

UNKNOWN = "unknown"

# How licences are usually stated.
STATEMENTS = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "This software is distributed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Distributed under the terms of the GPL version 2 or any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License",
        "You can redistribute this library under the terms of the GNU Lesser General Public License version 2.1",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain",
    ],
    "all-rights-reserved": [
        "All rights reserved",
        "Copyright by the author. All rights reserved",
        "Reproduction in whole or in part without written permission of the copyright holder is prohibited",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher",
    ],
}

# Sentences with words of licences that state none.
PLAIN = [
    "He lost his driving license on the way to work",
    "The license fee was paid to the city in version after version",
    "Students of MIT released a new study under the bridge",
    "Apache is the name of several peoples and of a web server",
    "The general public was free to use the library",
    "A copy of the letter is in the public library",
    "Creative work is common in this version of the story",
    "The software was released in May and is distributed by mail",
    "The foundation published the terms of its prize",
    "Rights and duties of the author were reserved for the next chapter",
    "The source of the river is subject to change",
    "Permission to enter was granted by the owner",
    "The work is under review and may be used later",
    "This file is a list of persons with a license to fish",
]

# What licences are called.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache v2", "Apache 2", "Apache License v2.0", "Apache Software License 2.0", "Apache License", "ASL 2.0"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat License", "MIT-style license", "MIT/X11 license", "X11 MIT license"],
    "gpl": ["GNU General Public License version 3", "GNU General Public License", "GNU GPL", "GPL", "GPLv3", "GPLv2", "GPL v3", "GPL v2", "GPL-3.0", "GPL-2.0-only", "GPL version 2", "GPL version 3", "GNU GPL version 2 or later", "GPL 3", "GPL 2"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0", "LGPL version 2.1", "Lesser GPL"],
    "agpl": ["GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL version 3", "Affero GPL"],
    "bsd": ["BSD License", "BSD", "3-clause BSD license", "BSD-3-Clause", "BSD 2-Clause License", "2-clause BSD license", "new BSD license", "modified BSD license", "simplified BSD license", "BSD-style license", "BSD licence"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPLv2", "MPL v2", "MPL"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons BY-SA"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons BY-NC"],
    "public-domain": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "the public domain", "the Unlicense"],
}

# Names that need a word about licences beside them, as they are names of other things too.
SHORT = ["mit", "bsd", "gpl", "mpl", "apache 2", "the public domain"]

# How a licence is stated.
FRAMES = [
    "licensed under {}", "this project is licensed under the terms of the {}", "released under the {}", "the code is released under {}",
    "distributed under the {}", "License: {}", "made available under {}", "published under the terms of {}",
    "{} licensed", "the package is {} licensed software", "see the LICENSE file ({})", "{}, see LICENSE",
    "subject to the terms of the {}", "covered by the {}", "governed by the {}", "you may use this under the {}",
    "our sources fall under {}", "this file is part of a work under the {}", "terms: {}", "license = {}",
    "copyright the authors, {}", "the documentation is under {}", "the {} applies to this repository", "you can redistribute it under {}",
    "contributions are accepted under the {}", "dual licensed under {}", "offered under {}", "this library uses the {}",
    "SPDX-License-Identifier: {}", "under the {} license", "dedicated to {}", "provided under {} without warranty",
]

# How things that licences are named after are mentioned.
MENTIONS = [
    "the history of {} is told in the next chapter", "students of {} met in the hall", "{} held a conference in the spring", "he worked for {} for ten years",
    "a talk about {} and its rivals", "the people of {} were under pressure", "{} released a new study", "{} is the name of a server and of a system",
    "we read about {} in the paper", "the river near {} was high", "{} published its yearly report", "the {} team lost by two goals",
    "what does {} mean", "the office of {} is in the city", "an engineer at {} wrote the first version", "they compared {} with others",
]

# What licences are named after, and what shares their words.
THINGS = ["MIT", "Apache", "BSD", "GNU", "Mozilla", "Creative Commons", "the public", "the general public", "CC", "the foundation", "the library"]

# What else things are licensed, released or published under.
OTHERS = ["zlib License", "ISC License", "Eclipse Public License 2.0", "Artistic License 2.0", "Boost Software License 1.0", "European Union Public Licence", "separate agreement", "law of 1990", "state board of health", "terms of the contract", "new name", "Microsoft Public License", "license of the vendor"]

#: Most documents that background paragraphs are taken from, and the longest text taken.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PARAGRAPHS = 300, 20_000, 1500
#: A paragraph with this share of the three-word n-grams of a statement may state a licence, so it is no background.
STATED = 1 / 3


def words_of(paragraph: Column) -> Column:
    """Lower-case words: runs of a-z and 0-9, as licence statements have no others that tell them apart."""
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column, known: list[str]) -> Column:
    """Distinct n-grams of one to three words that are among the known ones.

    Texts of n-grams are made only where their first word begins a known one of that length.
    """
    n = F.size(words)

    def runs(k: int) -> Column:
        first = sorted({g.split(" ")[0] for g in known if g.count(" ") == k - 1})
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        begun = F.filter(starts, lambda i: F.get(words, i - 1).isin(*first))
        return F.transform(begun, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    return F.array_distinct(F.filter(F.concat(F.filter(words, lambda w: w.isin(*known)), runs(2), runs(3)), lambda g: g.isin(*known)))


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False))


def _silent(background: list[list[str]]) -> list[list[str]]:
    """The paragraphs that hold less than STATED of the three-word n-grams of every statement."""
    statements = [_triples(_words(t)) for texts in STATEMENTS.values() for t in texts]
    return [w for w in background if not any(len(s & t) >= STATED * len(t) for s in [_triples(w)] for t in statements)]


def _marks(family: str) -> list[str]:
    """What states the family by itself where the classifier agrees: its names, short ones beside a word about licences."""
    names = list(dict.fromkeys(" ".join(_words(n)) for n in NAMES.get(family, [])))
    beside = ["{} license", "{} licence", "{} licensed", "license {}", "licence {}", "licensed {}", "under {}", "under the {}", "terms of {}", "terms of the {}"]
    domain = ["in {}", "to {}"]
    return [m for n in names for m in ([n] if n not in SHORT else [f.format(n) for f in (domain if n.startswith("the ") else beside)])]


def _template(words: list[str]) -> list[str]:
    """The n-grams that a paragraph is compared by: of up to three words only the whole."""
    return sorted(_grams(words)) if len(words) > 3 else [" ".join(words)]


def _stated(rng, plain: list[list[str]], every: int) -> list[tuple[list[str], set[str], int, bool]]:
    """words, n-grams with a word of the name, class, fitted: each name in some of FRAMES, some of these within a paragraph,
    and each mark within paragraphs. Each fourth frame, and a quarter of the paragraphs with marks, is kept for calibration."""
    out = []

    def within(words: list[str]) -> list[str]:
        other = plain[rng.integers(len(plain))]
        at = rng.integers(len(other) + 1)
        return other[:at] + words + other[at:]

    for k, family in enumerate(sorted(STATEMENTS), 1):
        for name in NAMES.get(family, []):
            for f in rng.permutation(len(FRAMES))[:every]:
                words = _words(FRAMES[f].format(name))
                grams = {g for g in _grams(words) if set(_words(name)) & set(g.split(" "))}
                out.append((within(words) if rng.random() < 0.4 else words, grams, k, bool(f % 4 < 3)))
        for mark in _marks(family):
            words = mark.split(" ")
            out += [(within(words), _grams(words), k, i % 4 < 3) for i in range(every // 4)]
    return out


def _unstated() -> list[tuple[list[str], bool]]:
    """words, fitted: what licences are named after mentioned, other licences stated."""
    mentioned = [(frame.format(n), i) for i, frame in enumerate(MENTIONS) for n in THINGS]
    others = [(frame.format(n), i) for i, frame in enumerate(FRAMES) for n in OTHERS]
    return [(_words(t), i % 4 < 3) for t, i in mentioned + others]


def _core(helps: dict[str, np.ndarray], offsets: np.ndarray, often: dict[str, int]) -> set[str]:
    """Words without one of which no paragraph scores above unknown.

    The most frequent words are left out as long as what the n-grams of left words alone add to a family, all taken
    together, stays below what unknown has over it. Every other n-gram that helps has its rarest word in the core.
    """
    held: dict[str, list[str]] = {}
    for g in helps:
        for word in set(g.split(" ")):
            held.setdefault(word, []).append(g)
    left, total = set(), np.zeros(len(offsets))
    for word in sorted(held, key=lambda t: (-often.get(t, 0), t)):
        more = total + sum((np.maximum(helps[g], 0) for g in held[word] if set(g.split(" ")) <= left | {word}), np.zeros(len(offsets)))
        if often.get(word, 0) and (more < -offsets - 1e-6).all():
            left.add(word)
            total = more
    return {min((t for t in g.split(" ") if t not in left), key=lambda t: (often.get(t, 0), t)) for g in helps if not set(g.split(" ")) <= left}


@dataclass(frozen=True)
class Model:
    """weights: for each n-gram one number a family, over unknown's; gate: words without one of which no n-gram speaks for a
    family; core: those of them without one of which all n-grams together don't outweigh unknown."""

    families: list[str]
    weights: dict[str, list[float]]
    offsets: list[float]
    gate: list[str]
    core: list[str]
    templates: list[tuple[int, str, list[str]]]


def _variants(rng, words: list[str], background: list[list[str]], n: int) -> list[list[str]]:
    out = [words]
    for _ in range(n):
        keep = [w for w in words if rng.random() > 0.12] or words
        if rng.random() < 0.5 and background:
            other = background[rng.integers(len(background))]
            at = rng.integers(len(other) + 1)
            keep = other[:at] + keep + other[at:]
        out.append(keep)
    return out


def fit(background: list[str], *, seed: int = 5, variants: int = 30, wordings: int = 16, rounds: int = 150) -> Model:
    """Trains on variants of STATEMENTS and on each of NAMES in some of FRAMES (wordings of them), against PLAIN, mentions of
    names, statements of other licences and those background paragraphs that hold no part of a statement."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *sorted(STATEMENTS)]
    plain = [w for w in [*map(_words, PLAIN), *_silent(list(map(_words, background)))] if w]
    examples = [(w, 0) for w in plain]
    templates = []
    for k, family in enumerate(families[1:], 1):
        for text in STATEMENTS[family]:
            w = _words(text)
            templates.append((len(templates), family, _template(w)))
            examples += [(v, k) for v in _variants(rng, w, plain, variants)]
            for _ in range(variants // 2):  # the statement's words without its order, and scraps of it, state nothing
                some = list(rng.permutation(w))[: max(1, len(w) // 2)]
                examples.append((plain[rng.integers(len(plain))] + some, 0))
        templates += [(len(templates) + i, family, _template(mark.split(" "))) for i, mark in enumerate(_marks(family))]
    made = rng.random(len(examples)) < 0.7
    stated, unstated = _stated(rng, plain, wordings), _unstated()
    examples += [(w, k) for w, _, k, _ in stated] + [(w, 0) for w, _ in unstated]
    fitted = np.concatenate([made, [f for *_, f in stated], [f for _, f in unstated]]).astype(bool)
    # of the sentences that are made, the n-grams with a word of the name: the words around it are those of any text
    named = {g for _, grams, _, f in stated if f for g in grams}
    known = {g for texts in STATEMENTS.values() for t in texts for g in _grams(_words(t))}
    often: dict[str, int] = {}
    for words in plain:
        for word in set(words):
            often[word] = often.get(word, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(known | named | {g for _, _, grams in templates for g in grams}))}
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, (w, _) in enumerate(examples):
        x[i, [vocabulary[g] for g in _grams(w) if g in vocabulary]] = 1
    y = np.array([k for _, k in examples])
    w, b = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    xf, goal = x[fitted], np.eye(len(families), dtype=np.float32)[y[fitted]]
    m = v = np.zeros_like(w)
    mb = vb = np.zeros_like(b)
    for t in range(1, rounds + 1):
        z = xf @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - goal) / len(goal)
        gw, gb = xf.T @ e + 1e-5 * w, e.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w, b = w - 0.08 * (m / c) / (np.sqrt(v / d) + 1e-8), b - 0.08 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    # unknown is the reference class; heat and its offset are calibrated on examples that were not fitted on
    w, b = w[:, 1:] - w[:, :1], b[1:] - b[0]
    z, truth = x[~fitted] @ w, y[~fitted]
    best = None
    # offsets stay below 0, so that a paragraph without any n-gram of a statement is unknown
    offsets = lambda heat, bias: np.minimum(b / heat - bias, -1e-3)
    for heat in (0.5, 0.7, 1.0, 1.4, 2.0):
        for bias in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0):
            s = np.hstack([np.zeros((len(z), 1)), z / heat + offsets(heat, bias)])
            loss = (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), truth]).mean()
            if best is None or loss < best[0]:
                best = (loss, heat, bias)
    w, b = w / best[1], offsets(*best[1:])
    # each n-gram that speaks for a family has a word in the gate, its rarest one: what the gate leaves out has none
    helps = [g for g, i in vocabulary.items() if w[i].max() > 0]
    gate = {min(g.split(" "), key=lambda t: (often.get(t, 0), t)) for g in helps}
    core = _core({g: w[i] for g, i in vocabulary.items() if w[i].max() > 0}, b, often)
    return Model(families[1:], {g: [float(a) for a in w[i]] for g, i in vocabulary.items()}, [float(a) for a in b], sorted(gate), sorted(core), templates)


def background_of(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_paragraphs: int = SAMPLE_PARAGRAPHS, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """Paragraphs that hold no word about licences, of a bounded sample: sample_docs rows of least id hash, the first
    sample_chars characters of each, sample_paragraphs paragraphs in all. It goes through the driver, so it is bounded."""
    texts = docs.select(F.col(id_col).alias("id"), F.substring(F.col(text_col).cast("string"), 1, sample_chars).alias("t"))
    ids = least_by_hash(texts.select("id").filter("id IS NOT NULL"), "id", sample_docs)
    rows = texts.join(F.broadcast(ids.distinct()), "id").filter("t IS NOT NULL").orderBy("id", "t").limit(sample_docs).collect()
    parts = [p for r in rows for p in r["t"].split("\n") if p.strip()]
    about = ("licen", "copyright", "spdx", "creative commons", "public domain", "cc by", "rights reserved")
    return [p for p in parts if not any(a in p.lower() for a in about)][:sample_paragraphs]


def scan(docs: DataFrame, model: Model, *, confirm: float = 0.6, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Paragraphs (lines) that state a licence: doc_id, paragraph (from 0), family, probability, similarity, confirmed, text.

    probability is the family's, calibrated against unknown; paragraphs whose likeliest class is unknown give no row.
    similarity: the largest share of the n-grams of one of the family's statements or marks that the paragraph holds (of
    texts of up to three words the whole counts alone); confirmed: it is confirm at least. Equal probabilities go to the family first by name. Null and empty texts give no rows; null
    and repeated ids are kept, each row by itself. A paragraph of any length is one: its distinct n-grams are summed.
    Empty tables give no rows, extra columns are ignored.

    Whole texts are scanned. What is joined is a few thousand n-grams, bounded by STATEMENTS, so broadcasting them is
    safe at any size of the input; sums are by row and paragraph, which no hot text or source can skew.
    """
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text"))
    gated = lines.withColumn("words", words_of(F.col("text"))).filter(F.exists("words", lambda w: w.isin(*model.core)))
    rows = gated.withColumn("row", F.monotonically_increasing_id()).withColumn("gram", F.explode(grams_of(F.col("words"), list(model.weights)))).drop("words")
    k = len(model.families)
    weights = spark.createDataFrame([(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(k)))
    key = ["row", "doc_id", "paragraph", "text"]
    sums = rows.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(k)), F.collect_list("gram").alias("grams"))
    scores = F.zip_with(F.array(*(F.col(f"w{i}") for i in range(k))), F.lit(model.offsets), lambda w, o: w + o)
    scored = sums.select(*key, "grams", scores.alias("scores")).withColumn("top", F.greatest(F.array_max("scores"), F.lit(0.0)))
    # no family is likelier than unknown unless some score is above 0
    likely = scored.filter(F.col("top") > 0)
    total = F.aggregate("scores", F.exp(-F.col("top")), lambda t, s: t + F.exp(s - F.col("top")))
    first = F.array_position("scores", F.col("top"))
    found = likely.select(*key, "grams", F.element_at(F.lit(model.families), first.cast("int")).alias("family"), (1 / total).alias("probability"))
    templates = spark.createDataFrame(model.templates, "template int, family string, statement array<string>")
    # a dozen families with some statements and marks each: one array of them a family
    by_family = F.broadcast(templates.groupBy("family").agg(F.collect_list("statement").alias("statements")))
    share = F.array_max(F.transform("statements", lambda s: F.size(F.array_intersect(s, F.col("grams"))) / F.size(s)))
    out = found.join(by_family, "family").withColumn("similarity", share)
    return out.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= confirm).alias("confirmed"), "text")
