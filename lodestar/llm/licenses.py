"""License scans with DataFrame functions only.

A logistic regression over word 1- and 2-grams, trained on labelled notices below,
names the licence family of a paragraph or ``unknown``; comparison with the family's
notices confirms it.  Paragraphs end at blank lines, and a notice may wrap over the lines
of one; windows of words find it wherever it stands.  The model is a fixed, small table,
so scoring is a join with it.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

UNKNOWN, RESERVED = "unknown", "proprietary"
#: Notices of each family, as they stand in files.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-3.0-or-later",
        "GPL-3.0",
        "This program is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GPL-2.0",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "LGPL-3.0",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "AGPL-3.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "EPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
        "ISC License",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "The Unlicense",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC 4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "CC BY-SA 4.0",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
        "CC BY-ND 4.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. Reproduction without written permission is prohibited.",
    ),
}
#: Ordinary sentences with the same words, labelled unknown.
OTHERS = (
    "The driver showed a license and the version of the public register was 3.",
    "A fishing license is issued under the terms of the county.",
    "The work of the general public was free of charge in source and form.",
    "The clause was subject to conditions, and the foundation permitted no change.",
    "He reserved all seats and had the rights of use without restriction.",
    "This program is about software and its documentation.",
    "The creative work of the commons is international and needs attribution.",
    "Permission to copy the files was granted by the person in charge.",
    "The apache helicopter is version 2 of the model.",
    "The university released a study under the new license law.",
    "A copy of the document is licensed to the office.",
    "The source code of the project is in binary form.",
    "Redistribution of wealth is subject to the public debate.",
    "Copyright law in the country changed.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: CDDL-1.0",
    "Boost Software License, Version 1.0.",
    "Licensed under the Artistic License, Version 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided as is, without any express or implied warranty.",
    "Permission is granted to anyone to use this software for any purpose.",
)
#: Words that stand in most texts.
COMMON = frozenset("a all and any are as be by can following for form free in is it may met not of or provided that the this to use under using version with without work you later".split())
#: Words that name a licence or a version; a notice is confirmed only by a text that holds all of its own.
NAMES = frozenset(
    "apache mit gnu gpl lgpl agpl affero lesser mozilla mpl bsd isc unlicense unencumbered eclipse epl cc by nc sa nd creative commons attribution noncommercial sharealike noderivatives "
    "charge fee redistribution reserved general 0 1 2 3 4".split())
#: Words that make another licence of a notice that lacks them; ``negated`` stands for a clause that says what is not so.
MODIFIERS = "affero lesser library sharealike sa noderivatives noderivs nd noncommercial nc negated".split()
NEGATED = r"(?:^| )(?:not|never|no longer)(?: (?:be|been|being|is|are))? (?:licensed|released|available|covered|distributed|governed|provided|published)(?: [a-z0-9]+){0,12}"
OVERLAP = 0.8  # least share of a notice's distinct words that a text must hold to confirm it
SCALE = 1024  # weights are whole numbers of 1 / SCALE, so sums are exact in any order
MAX_NGRAMS = 4096
#: Words of the windows that are laid over a paragraph, at strides of half of it, beside the
#: paragraph as a whole: any notice of half a window's words stands whole in some window.
WINDOWS = (8, 16, 32, 64)
#: Most unknown held-out samples, as a share, that may be called a family.
FALSE_ALARMS = 0.005
LOST = 0.005  # most held-out notices, as a share, that the threshold may cost


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def ngrams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


FAMILIES = (UNKNOWN, *TEMPLATES)


def marks(notice: str) -> tuple[list[str], list[str]]:
    """Words that a text must hold for this notice, and words that it must not."""
    own = set(words_of(notice))
    return sorted(own & NAMES), sorted(set(MODIFIERS) - own)


@functools.cache
def gate() -> tuple[str, ...]:
    """Words of which every text that any notice confirms holds one at least.

    Such a text holds all names of the notice, so one of them is enough; and it lacks
    n - ceil(OVERLAP * n) of its n words at most, so one more than that of any are enough.
    Words are taken until every notice has enough, shared ones first; numbers, COMMON
    words and words of three letters stand in ordinary texts and come last.
    """
    notices = [(set(words_of(t)), set(marks(t)[0])) for t in sum(TEMPLATES.values(), ())]
    more = lambda words: len(words) - math.ceil(OVERLAP * len(words) - 1e-9) + 1
    rare = lambda w: not w.isdigit() and w not in COMMON and len(w) > 3
    chosen: set[str] = set()
    while open_ := [n for n in notices if not n[1] & chosen and len(n[0] & chosen) < more(n[0])]:
        useful = {}
        for words, names in open_:
            few = [w for w in words if rare(w) and (w in names or more(words) == 1)] or [w for w in words if rare(w)]
            if len([w for w in words if rare(w)]) < more(words) and not any(w in names for w in few):
                few = [w for w in names if not w.isdigit()] or list(names)
            for w in set(few) - chosen:
                useful[w] = useful.get(w, 0) + 1
        chosen.add(max(sorted(useful), key=lambda w: (rare(w), w not in COMMON, useful[w], len(w))))
    return tuple(sorted(chosen))


def samples(seed: int = 5, each: int = 16) -> list[tuple[set[str], int]]:
    """Labelled paragraphs: notices and other sentences, with words lost and filler around them."""
    rnd = random.Random(seed)
    filler = sorted({w for s in OTHERS for w in words_of(s)})
    out = []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, OTHERS):
            words = words_of(t)
            for _ in range(each):
                kept = [w for w in words if rnd.random() > (0.0 if family in TEMPLATES and len(words) < 8 else 0.06)]
                around = [rnd.choices(filler, k=rnd.choice((0, 0, 0, 2, 6))) for _ in range(2)]
                out.append((ngrams([*around[0], *kept, *around[1]]), k))
    for _ in range(12 * each):  # words in no order, half of them from notices, are no notice
        pool = filler + [w for t in sum(TEMPLATES.values(), ()) for w in words_of(t)]
        out.append((ngrams(rnd.choices(pool, k=rnd.randint(1, 14))), 0))
    return out


def _rows(data: list[tuple[set[str], int]], at: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(data), len(at) + 1))
    x[:, -1] = 1
    for i, (grams, _) in enumerate(data):
        x[i, [at[g] for g in grams if g in at]] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@functools.cache
def model(seed: int = 5, steps: int = 200) -> tuple[dict[str, tuple[int, ...]], tuple[int, ...], float]:
    """Weights of each n-gram and biases, by family in the order of FAMILIES, in units of 1 / SCALE; the threshold.

    Calibrated on samples of another seed: logits are divided by the temperature of the
    greatest likelihood there.  The threshold is the greatest that loses no more than LOST
    of the notices that are rightly called, and at least the one above which no more than
    FALSE_ALARMS of the unknown ones are called a family.
    """
    data = samples(seed)
    vocabulary = sorted({g for t in sum(TEMPLATES.values(), ()) + OTHERS for g in ngrams(words_of(t))})[:MAX_NGRAMS]
    at = {g: i for i, g in enumerate(vocabulary)}
    x = _rows(data, at)
    y = np.eye(len(FAMILIES))[[k for _, k in data]]
    w = np.zeros((x.shape[1], len(FAMILIES)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (_softmax(x @ w) - y) / len(x) + 2e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    held = samples(seed + 1)
    z, k = _rows(held, at) @ w, np.array([k for _, k in held])
    loss = lambda heat: -np.log(_softmax(z / heat)[np.arange(len(k)), k] + 1e-12).mean()
    heat = min((h / 20 for h in range(4, 61)), key=loss)
    q = np.rint(w / heat * SCALE).astype(int)
    p = _softmax(_rows(held, at) @ q / SCALE)[k == 0]
    called = np.where(p.argmax(1) > 0, p.max(1), 0)
    quiet = next(t for t in range(1, 100) if (called >= t / 100).mean() <= FALSE_ALARMS)
    p = _softmax(_rows(held, at) @ q / SCALE)
    right = p[np.arange(len(k)), k][(k > 0) & (p.argmax(1) == k)]
    threshold = max([quiet, *(t for t in range(1, 100) if (right < t / 100).mean() <= LOST)]) / 100
    return {g: tuple(q[i].tolist()) for g, i in at.items()}, tuple(q[-1].tolist()), threshold


def _scored(kinds: DataFrame) -> DataFrame:
    """``(words, predicted, probability, overlap, family)`` of distinct ``kinds(words)``."""
    spark = kinds.sparkSession
    weights, bias, threshold = model()
    n = len(FAMILIES)
    table = F.broadcast(spark.createDataFrame([(g, list(w)) for g, w in sorted(weights.items())], "gram string, w array<int>"))  # at most MAX_NGRAMS rows
    pairs = F.expr("if(size(words) < 2, array(), transform(sequence(0, size(words) - 2), i -> concat(words[i], ' ', words[i + 1])))")
    grams = kinds.select("words", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram")).join(table, "gram")
    sums = [(F.sum(F.col("w")[k]) + bias[k]).alias(f"s{k}") for k in range(n)]
    z = grams.groupBy("words").agg(*sums)  # a text without any gram of the model is unknown, and confirms nothing
    top = F.greatest(*[F.col(f"s{k}") for k in range(n)])
    best = functools.reduce(lambda c, k: c.when(F.col(f"s{k}") == top, FAMILIES[k]), range(1, n), F.when(F.col("s0") == top, FAMILIES[0]))
    total = sum((F.exp((F.col(f"s{k}") - top) / SCALE) for k in range(1, n)), F.exp((F.col("s0") - top) / SCALE))
    scored = z.select("words", best.alias("best"), F.round(1 / total, 6).alias("probability"))
    scored = scored.withColumn("predicted", F.when(F.col("probability") >= threshold, F.col("best")).otherwise(UNKNOWN))
    overlaps = []
    for family, texts in TEMPLATES.items():
        parts = []
        for t in texts:
            must, never = marks(t)
            share = F.size(F.array_intersect("words", F.array(*map(F.lit, sorted(set(words_of(t))))))) / F.lit(len(set(words_of(t))))
            fits = functools.reduce(lambda c, w: c & F.array_contains("words", w), must, ~F.arrays_overlap("words", F.array(*map(F.lit, never))))
            parts.append(F.when(fits, share).otherwise(0.0))
        overlaps.append((family, F.greatest(*parts, F.lit(0.0))))
    overlap = functools.reduce(lambda c, fo: c.when(F.col("predicted") == fo[0], fo[1]), overlaps[1:], F.when(F.col("predicted") == overlaps[0][0], overlaps[0][1])).otherwise(0.0)
    return scored.withColumn("overlap", F.round(overlap, 6)).withColumn("family", F.when(F.col("overlap") >= OVERLAP, F.col("predicted")).otherwise(UNKNOWN)).drop("best")


#: Where a paragraph ends: at lines without a letter or digit, comment marks or not.
BLANK = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence family confirmed in a paragraph, or one ``unknown`` row where a word of ``gate()`` stands but none is.

    ``(doc_id, paragraph, predicted, probability, overlap, family)``: paragraphs are
    numbered from 0 in their text.  Each is scored whole and by WINDOWS of its words, and
    the best of these gives the row; ``predicted`` is the likeliest class if its
    probability is at least the calibrated threshold, else unknown; ``family`` is the
    predicted one if the best of its notices overlaps by OVERLAP, else unknown.
    Null and empty texts have no rows, an empty table gives none; rows that repeat an id
    each have their own, told apart by nothing but their text; other columns, whatever
    their names, are not read.
    """
    blocks = docs.select(col(id_col).alias("doc_id"), F.posexplode(F.split(col(text_col), BLANK)).alias("paragraph", "block"))
    plain = F.lower(F.array_join(F.regexp_extract_all("block", F.lit("[A-Za-z0-9]+"), F.lit(0)), " "))  # ASCII by now
    plain = F.regexp_replace(plain, NEGATED, " negated")
    blocks = blocks.select("doc_id", "paragraph", F.split(plain, " ").alias("all"))
    words = F.array(*map(F.lit, gate()))
    blocks = materialize(blocks.where(F.arrays_overlap("all", words)).withColumn("pid", F.sha2(F.array_join("all", " "), 256)))  # read twice
    # equal paragraphs are scored once, and so are equal windows: a hot notice is one row from here on
    kinds = blocks.groupBy("pid").agg(F.first("all").alias("all"))
    laid = [F.expr(f"transform(sequence(0, greatest(0, ceil((size(all) - {w}) / {w // 2}))), i -> slice(all, int(1 + i * {w // 2}), {w}))") for w in WINDOWS]
    parts = kinds.select("pid", F.explode(F.array_distinct(F.concat(F.array("all"), *laid))).alias("words")).where(F.arrays_overlap("words", words))
    best = parts.join(_scored(parts.select("words").distinct()), "words")
    rank = F.struct("overlap", "probability", "predicted")
    best = best.groupBy("pid", "family").agg(F.max(rank).alias("r"))
    # reserved rights stand in most headers: with another licence in the paragraph they say nothing more
    named = ~F.col("family").isin(UNKNOWN, RESERVED)
    known = best.groupBy("pid").agg(F.bool_or(F.col("family") != UNKNOWN).alias("known"), F.bool_or(named).alias("named"))
    kept = (~F.col("known") | (F.col("family") != UNKNOWN)) & ~(F.col("named") & (F.col("family") == RESERVED))
    best = materialize(best.join(known, "pid").where(kept).select("pid", "family", "r"))
    return blocks.select("doc_id", "paragraph", "pid").join(best, "pid").select("doc_id", "paragraph", "r.predicted", "r.probability", "r.overlap", "family")


def oracle_sql() -> str:
    """The same over the ``documents`` view, for DuckDB."""
    weights, bias, threshold = model()
    n = len(FAMILIES)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ks = range(n)
    gated = lambda c: f"list_has_any({c}, [{', '.join(map(q, gate()))}])"
    sums = ", ".join(f"sum(w[{k + 1}]) + {bias[k]} AS s{k}" for k in ks)
    top = "greatest(" + ", ".join(f"s{k}" for k in ks) + ")"
    best = "CASE " + " ".join(f"WHEN s{k} = top THEN {q(FAMILIES[k])}" for k in ks) + " END"
    total = " + ".join(f"exp((s{k} - top) / {SCALE}.0)" for k in ks)
    over = []
    for family, texts in TEMPLATES.items():
        parts = []
        for t in texts:
            own, (must, never) = sorted(set(words_of(t))), marks(t)
            held = f"list_has_all(words, [{', '.join(map(q, must))}]) AND " if must else ""
            parts.append(f"CASE WHEN {held}NOT list_has_any(words, [{', '.join(map(q, never))}]) THEN len(list_intersect(words, [{', '.join(map(q, own))}])) / {len(own)}.0::DOUBLE ELSE 0.0 END")
        over.append(f"WHEN predicted = {q(family)} THEN greatest(0.0, {', '.join(parts)})")
    rows = ", ".join(f"({q(g)}, {list(w)})" for g, w in sorted(weights.items()))
    windows = "\nUNION ALL ".join(f"SELECT ws, unnest([ws[i * {w // 2} + 1:i * {w // 2} + {w}] FOR i IN range(0, greatest(0, CAST(ceil((len(ws) - {w}) / {w / 2})  AS BIGINT)) + 1)]) AS words FROM whole" for w in WINDOWS)
    return f"""
WITH model(gram, w) AS (VALUES {rows}),
docs AS (SELECT doc_id, string_split_regex(text, '\\n(?:[^A-Za-z0-9\\n]*\\n)+') AS bs FROM documents),
blocks AS (SELECT doc_id, unnest(range(0, len(bs))) AS paragraph, unnest(bs) AS block FROM docs),
listed AS (SELECT doc_id, paragraph, string_split(regexp_replace(trim(lower(regexp_replace(block, '[^A-Za-z0-9]+', ' ', 'g'))), {q(NEGATED)}, ' negated', 'g'), ' ') AS ws FROM blocks),
hits AS (SELECT * FROM listed WHERE {gated('ws')}),
whole AS (SELECT DISTINCT ws FROM hits),
parts AS (SELECT DISTINCT ws, words FROM (SELECT ws, ws AS words FROM whole
UNION ALL {windows}) WHERE {gated('words')}),
kinds AS (SELECT DISTINCT words FROM parts),
grams AS (SELECT DISTINCT words, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))])) AS gram FROM kinds),
z AS (SELECT g.words, {sums} FROM grams g JOIN model m USING (gram) GROUP BY g.words),
t AS (SELECT *, {top} AS top FROM z),
p AS (SELECT words, {best} AS best, round(1 / ({total}), 6) AS probability FROM t),
r AS (SELECT *, CASE WHEN probability >= {threshold} THEN best ELSE '{UNKNOWN}' END AS predicted FROM p),
o AS (SELECT *, round(CASE {' '.join(over)} ELSE 0.0 END, 6) AS overlap FROM r),
f AS (SELECT *, CASE WHEN overlap >= {OVERLAP} THEN predicted ELSE '{UNKNOWN}' END AS family FROM o),
b AS (SELECT ws, family, overlap, probability, predicted, row_number() OVER (PARTITION BY ws, family ORDER BY overlap DESC, probability DESC, predicted DESC) AS k,
  bool_or(family <> '{UNKNOWN}') OVER (PARTITION BY ws) AS known, bool_or(family NOT IN ('{UNKNOWN}', '{RESERVED}')) OVER (PARTITION BY ws) AS named FROM parts JOIN f USING (words))
SELECT h.doc_id, CAST(h.paragraph AS INTEGER) AS paragraph, b.predicted, b.probability, b.overlap, b.family
FROM hits h JOIN b USING (ws) WHERE b.k = 1 AND (NOT b.known OR b.family <> '{UNKNOWN}') AND NOT (b.named AND b.family = '{RESERVED}')"""
