"""Licence scans by a trained paragraph classifier, in DataFrame functions on the data's path.

A paragraph is a line with the lines that it is wrapped over, and is scored sentence by sentence. Sentences with a word that
licences are made of, or that any confirmed one must have (the gate), are split into word n-grams; a multinomial logistic
regression over n-grams, trained here from the labelled lines below, gives each family a probability by the n-grams that it
knows, so that prose around a licence doesn't dilute it. Its temperature is fitted on predictions for folds left out, and a
sentence whose best probability is below `confident` is of unknown licence, as is one that holds too few of the n-grams of
every template of the predicted family."""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import join_by_hot_key, let, stage_table

#: Labelled lines by family; "other" are lines about licences of no family here, "none" are not licences at all.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Licensed under the MIT license.", "This project is licensed under the terms of the MIT License.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)", "Distributed under the MIT licence, see the file LICENSE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Released under the Apache License 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "This work is available under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "Licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 3 or later.", "Licensed under the GPL v2.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v3.", "This library is licensed under the GNU LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This work is licensed under the GNU AGPL version 3."],
    "BSD": [
        "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Licensed under the BSD 2-Clause license.", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the new BSD licence.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL": ["Licensed under the Mozilla Public License, Version 2.0.", "Released under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under the Creative Commons Attribution License, version 3.0.", "SPDX-License-Identifier: CC-BY-4.0", "Content is available under CC BY 3.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Content is available under CC BY-SA 3.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under the Creative Commons Attribution-NonCommercial License.", "Content is available under CC BY-NC 2.0."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0 Universal).", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0.", "This is free and unencumbered software released into the public domain."],
    "other": [
        "Licensed under the Acme Commercial License.", "Copyright 2020 Example Corporation. All rights reserved.", "See the LICENSE file for details.", "Use is subject to license terms.", "This software is proprietary and may not be copied without permission.", "Licensed under the terms of the vendor agreement, version 5.", "SPDX-License-Identifier: LicenseRef-Proprietary", "Released under the house license.", "Copyright notice", "Your license key is invalid.",
    ],
    "none": [
        "She renewed her driving license at the office.", "The license fee for the hall rose again.", "He asked for permission to leave early.", "The pub lost its licence last year.", "Poetic license allows such rhymes.", "A warranty covers the washing machine for two years.", "The apache helicopter landed at noon.", "MIT researchers found a new method.", "The public domain of the town is wide.", "Permission slips are due on Friday.", "The gnu grazed by the river.", "Mit.", "Mit und.", "Er kam mit dem Zug.", "Sie ging mit ihm nach Hause.", "The software was released in June.", "The band released a record under a new name.", "This work was distributed among the members.", "A version of the song is available.",
    ],
}
#: What licences are made of: a sentence without any of these has a row only if it is confirmed.
GATE = ("licens", "licenc", "lizenz", "copyright", "permission", "warrant", "redistribut", "creative commons", "public domain", "spdx", "rights reserved")
GATE_STARTS = r"(?<!\w)(?:gnu\b|[al]?gpl|mpl|cc0|cc[ -]by)"
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def grams_of(line: str) -> list[str]:
    """Distinct word n-grams, n up to 3, of a line; numbers with a dot count as version numbers."""
    words = [re.sub(r"^v?\d+(\.\d+)*$", "#", w) for w in re.findall(TOKEN, line.lower())]
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def grams(line: Column) -> Column:
    """grams_of as a column."""
    words = F.transform(F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), 1), lambda w: F.regexp_replace(w, r"^v?\d+(\.\d+)*$", "#"))

    def all_of(w: Column) -> Column:
        runs = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), _slice(w, n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
        return F.array_distinct(F.concat(*runs))

    return let(words, all_of)


def _slice(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 200, rate: float = 2.0) -> np.ndarray:
    """Weights (features + intercept) x classes of a multinomial logistic regression, by gradient steps with momentum."""
    x = np.column_stack([x, np.ones(len(x))])
    w, v = np.zeros((x.shape[1], y.shape[1])), 0.0
    for _ in range(steps):
        grad = x.T @ (softmax(x @ w) - y) / len(x) + ridge * w / len(x)
        v = 0.9 * v - rate * grad
        w = w + v
    return w


@functools.cache
def trained() -> tuple[list[str], list[str], np.ndarray, float]:
    """(classes, n-grams, weights, temperature). The temperature is the one under which folds left out of training are
    most likely."""
    classes = list(TEMPLATES)
    lines = [(k, grams_of(x)) for k, v in TEMPLATES.items() for x in v]
    names = sorted({g for _, gs in lines for g in gs})
    at = {g: i for i, g in enumerate(names)}
    x, y = np.zeros((len(lines), len(names))), np.zeros((len(lines), len(classes)))
    for i, (k, gs) in enumerate(lines):
        x[i, [at[g] for g in gs]] = 1 / np.sqrt(len(gs))
        y[i, classes.index(k)] = 1
    folds = np.arange(len(lines)) % 8
    held = np.zeros_like(y)
    for f in range(8):
        w = logistic(x[folds != f], y[folds != f])
        held[folds == f] = np.column_stack([x[folds == f], np.ones((folds == f).sum())]) @ w
    temperature = min(np.arange(0.3, 3.01, 0.1), key=lambda t: -np.log(softmax(held / t)[y == 1]).sum())
    return classes, names, logistic(x, y), float(temperature)


def in_gate(line: Column) -> Column:
    """Whether a text holds a word of the gate, case apart. A filter would lower it for each word, so it is bound first."""
    return let(F.lower(line), lambda low: functools.reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in GATE]) | low.rlike(GATE_STARTS))


def needed(share: float) -> set[str]:
    """Words of which a sentence has one if it has `share` of the n-grams of a template of a family: without them, no template
    has enough n-grams left."""
    words: set[str] = set()
    plain = {w for x in TEMPLATES["none"] for w in grams_of(x)}
    for x in (x for k, v in TEMPLATES.items() if k not in ("other", "none") for x in v):
        own = grams_of(x)
        for w in sorted((g for g in own if " " not in g and g != "#"), key=lambda w: (not any(x in w for x in GATE), w in plain, -len(w), w)):
            if sum(words.isdisjoint(g.split()) for g in own) < len(own) * share:
                break
            words.add(w)
    return words


def any_of(words: set[str]) -> str:
    """A pattern of the words in which those with a common start share it, so that few ways are tried at each place."""
    ways = []
    for first in sorted({w[0] for w in words if w}):
        rest = {w[1:] for w in words if w[:1] == first}
        ways.append(re.escape(first) + (any_of(rest) if rest != {""} else ""))
    return f"(?:{'|'.join(ways)}){'?' if '' in words else ''}"


def may(line: Column, share: float) -> Column:
    """Whether a text is in the gate or has a word that `share` of a template needs; any is when none is needed."""
    if share <= 0:
        return F.lit(True)
    return in_gate(line) | F.lower(line).rlike(f"(?<![a-z0-9]){any_of(needed(share))}(?![a-z0-9])")


def sentences(docs: DataFrame, share: float) -> DataFrame:
    """(doc_id, line_no, sentence_no, line): the sentences of paragraphs that may have `share` of a template. A line belongs to the paragraph
    of the line before it if that doesn't end a sentence and it doesn't start with a capital letter."""
    whole = F.regexp_replace("text", r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?=[\p{Ll}(\"])", " ")
    paragraphs = docs.select("doc_id", F.posexplode(F.split(whole, "\n")).alias("line_no", "line")).where(may(F.col("line"), share))
    return paragraphs.select("doc_id", "line_no", F.posexplode(F.split("line", r"(?<=[.!?])[ \t]+(?=[\p{Lu}(\"])")).alias("sentence_no", "line"))


def scan(docs: DataFrame, confident: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, line_no, sentence_no, line, family, probability, similarity, confirmed): a row for each sentence of a document
    that is confirmed, or has a word of GATE and isn't of class "none". family is "unknown" where the classifier isn't
    confident, says "other", or the sentence holds less than `overlap` of the n-grams of each template of its family;
    similarity is the most it holds. line_no counts paragraphs, which wrapped lines join.

    Null and empty texts have no rows, nor has an empty table; repeated rows and lines are reported each time; columns
    other than doc_id and text play no part."""
    spark = docs.sparkSession
    classes, names, weights, temperature = trained()
    line = F.col("line")
    lines = sentences(docs, overlap).where(may(line, overlap))
    lines = stage_table(lines, "lines")
    distinct = stage_table(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "distinct")
    parts = stage_table(distinct.select("line", grams(F.col("line")).alias("grams")), "grams").where(F.size("grams") > 0)
    model = spark.createDataFrame([(g, [float(x) for x in weights[i]]) for i, g in enumerate(names)], "gram string, w array<double>")
    bias = [float(x) for x in weights[-1]]
    found = parts.select("line", F.explode("grams").alias("gram")).join(F.broadcast(model), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(classes))]
    z = [(F.col(f"w{i}") / F.sqrt("known") + bias[i]) / temperature for i in range(len(classes))]
    scores = found.groupBy("line").agg(F.count(F.lit(1)).alias("known"), *sums).select("line", F.array(*z).alias("z"))
    scores = scores.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z")))).withColumn("probability", F.try_divide(F.lit(1.0), F.aggregate("e", F.lit(0.0), lambda a, x: a + x)))
    best = scores.select("line", "probability", F.array(*map(F.lit, classes))[F.array_position("z", F.array_max("z")).cast("int") - 1].alias("predicted"))
    kept = [(k, f"{k}/{i}", grams_of(x)) for k, v in TEMPLATES.items() if k not in ("other", "none") for i, x in enumerate(v)]
    forms = spark.createDataFrame([(k, form, len(gs), g) for k, form, gs in kept for g in gs], "predicted string, form string, form_size int, gram string")
    told = best.where(~F.col("predicted").isin("other", "none"))
    shared = parts.select("line", F.explode("grams").alias("gram")).join(told.select("line", "predicted"), "line").join(F.broadcast(forms), ["predicted", "gram"])
    near = shared.groupBy("line", "form", "form_size").agg(F.count(F.lit(1)).alias("same")).groupBy("line").agg(F.max(F.col("same") / F.col("form_size")).alias("similarity"))
    judged = best.where("predicted <> 'none'").join(near, "line", "left").fillna(0.0, ["similarity"])
    sure = (F.col("predicted") != "other") & (F.col("probability") >= confident) & (F.col("similarity") >= overlap)
    judged = judged.select("line", F.when(sure, F.col("predicted")).otherwise("unknown").alias("family"), "probability", "similarity", sure.alias("confirmed")).where(F.col("confirmed") | in_gate(line))
    verdicts = stage_table(judged.join(distinct, "line"), "verdicts")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_by_hot_key(lines, verdicts, "line", "n", total)
