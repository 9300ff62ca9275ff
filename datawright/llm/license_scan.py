"""License scans, on DataFrame operations: a trained paragraph classifier confirmed by template comparison.

Paragraphs are separated by blank lines (lines of comment marks count as blank); their lines are joined, so wrapped notices are whole, and as one
paragraph may name several licences, each of its sentences is classified. Sentences with a licence word (``ANCHORS``; every template has one)
are candidates; their distinct word 1- and 2-grams meet the sparse weights of a softmax regression, a broadcast table of
at most ``MOST_FEATURES`` rows, and are summed per sentence. A prediction counts if it is a licence family, its calibrated probability reaches the
cutoff, and the sentence holds at least ``CONFIRM`` of the 2-grams of one of the family's templates; else the sentence is ``unknown``.

Templates are the sentences of whole notices (``NOTICES``), short statements, and the identifiers of ``SPDX``. The regression is trained on the
driver on ``TRAIN`` variations of the templates and of other sentences, with a fixed seed; temperature and cutoff are set on held-out
variations. Tests hold it against notices in wordings that are not among the templates.

Null and empty texts have no paragraphs. Each input row gives one result row, repeated rows too; an empty table gives none.
Texts, paragraphs and sentences of any length are read whole.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, staged

# Notices by which works name their licence.
NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at the address of the Apache foundation. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU General Public License along with this program.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "AGPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU Affero General Public License along with this program.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "MPL": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.""",
    "Public-Domain": """This is free and unencumbered software released into the public domain. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "Proprietary": """No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher. Unauthorized copying of this file, via any medium, is strictly prohibited: proprietary and confidential, all rights reserved.""",
}
# Short statements.
STATEMENTS = {
    "MIT": ["released under the mit license", "licensed under the mit license", "the mit license", "mit licensed"],
    "ISC": ["licensed under the isc license", "released under the isc license", "the isc license"],
    "Apache": ["licensed under the apache license version", "released under the apache license", "apache license version 2 0"],
    "GPL": ["this work is licensed under the gnu general public license version", "released under the gnu general public license", "licensed under the gnu gpl", "under the terms of the gnu general public license", "distributed under the gpl license"],
    "LGPL": ["licensed under the gnu lesser general public license version", "under the terms of the gnu lesser general public license", "licensed under the gnu lgpl", "distributed under the lgpl license"],
    "AGPL": ["licensed under the gnu affero general public license version", "under the terms of the gnu affero general public license", "licensed under the gnu agpl", "distributed under the agpl license"],
    "BSD": ["licensed under the bsd license", "released under the bsd license", "the bsd 3 clause license", "the bsd 2 clause license", "can be found under a bsd style license"],
    "MPL": ["subject to the terms of the mozilla public license", "licensed under the mozilla public license version"],
    "Zlib": ["licensed under the zlib license", "released under the zlib license"],
    "CC-BY": ["licensed under cc by", "licensed under a creative commons attribution license", "creative commons attribution 4 0 international license"],
    "CC-BY-SA": ["licensed under cc by sa", "licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC": ["licensed under cc by nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial 4 0 international license"],
    "Public-Domain": ["this work is released into the public domain", "dedicated to the public domain"],
    "Proprietary": ["all rights reserved", "no part of this publication may be reproduced without permission"],
}
# Identifiers of licences.
SPDX = {
    "MIT": ["MIT"], "ISC": ["ISC"], "Apache": ["Apache-2.0"], "GPL": ["GPL-2.0", "GPL-3.0"], "LGPL": ["LGPL-2.1", "LGPL-3.0"], "AGPL": ["AGPL-3.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL": ["MPL-2.0"],
    "Zlib": ["Zlib"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "Public-Domain": ["Unlicense", "CC0-1.0"],
}
# Sentences with licence words that name no licence.
OTHERS = [
    "he lost his driving license last year", "the license fee was raised again", "a license is required to fish here", "copyright law is older than the press", "they asked for permission to enter the public garden",
    "the warranty covers parts and labour", "the general public was not admitted", "the apache helicopter landed", "students at mit released the results", "the attribution of the painting is unclear", "a creative mind and common sense",
    "the terms of the agreement were kept under lock", "version two was released under pressure", "the company licensed its brand to others", "mozilla is a browser", "rights and duties of the public", "the bar lost its license", "the doctor is licensed to practise in two states",
    "the copyright of the song was sold", "you need written permission to copy the key", "the distribution of the software was delayed", "free software was given away at the fair", "the foundation published its report", "her driving license was found under the seat", "the file is subject to review",
    "a license plate was stolen", "the rights of the author were discussed", "the public domain of the king was large", "permission was granted to build the house", "he modified the terms of the contract with permission", "the source of the river is unknown", "redistribution of wealth was debated",
]
WORD = "[a-z0-9]+"
SENTENCE_END = "(?<=[.!?])[\"')\\]]*\\s+(?=[\"'(\\[]?[A-Z0-9])"
PARAGRAPH_END = "\n[ \\t\\r\\f*#/;%!-]*(?=\n)"


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
    return sorted({*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))})


def sentences(text: str) -> list[str]:
    """Sentences of a text, paragraph by paragraph: the plain meaning of ``candidates``."""
    found = []
    for paragraph in re.split(PARAGRAPH_END, text, flags=re.A):
        found += re.split(SENTENCE_END, re.sub(r"\s+", " ", paragraph, flags=re.A), flags=re.A)
    return found


#: Words of the sentences that are looked at.
ANCHORS = "license licence licensed licenses licences licensing copyright copyleft rights permission redistribution redistributions redistribute domain spdx prohibited".split()
ANCHOR = rf"(?i)(?<![a-z0-9])(?:{'|'.join(ANCHORS)})(?![a-z0-9])"


def _templates() -> dict[str, list[str]]:
    made = {}
    for family in {**NOTICES, **STATEMENTS}:
        noticed = [s for s in sentences(NOTICES.get(family, "")) if re.search(ANCHOR, s, re.A)]
        made[family] = [" ".join(re.findall(WORD, t.lower())) for t in [*noticed, *STATEMENTS.get(family, ()), *(f"SPDX License Identifier {i}" for i in SPDX.get(family, ()))]]
    return made


TEMPLATES = _templates()
TRAIN, CONFIRM, MOST_FEATURES = 3_000, 0.75, 5_000


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    cutoff: float


def _variation(r: random.Random) -> tuple[str, str]:
    letters = lambda k: " ".join("".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 8))) for _ in range(k))

    def filler(k: int) -> str:
        words = r.choice(OTHERS).split()
        a = r.randrange(len(words))
        return " ".join([letters(k), *words[a : a + r.randint(0, 4)]]) if r.random() < 0.4 else letters(k)

    if r.random() < 0.35:
        family, text = "unknown", r.choice([*OTHERS, *OTHERS, filler(r.randint(3, 25))])
    else:
        family = r.choice(list(TEMPLATES))
        text = r.choice(TEMPLATES[family])
    words = text.split()
    for _ in range(max(1, len(words) // 20)):
        if len(words) > 5 and r.random() < 0.3:
            del words[r.randrange(len(words))]
    return f"{filler(r.randint(0, 8))} {' '.join(words)} {r.choice(['', '2 0', '3', '4 0', filler(3)])} {filler(r.randint(0, 12))}", family


@functools.lru_cache(maxsize=2)
def fit(train: int = TRAIN, seed: int = 11, steps: int = 200, rate: float = 1.0, decay: float = 1e-4) -> Model:
    """Softmax regression by accelerated gradient descent; small weights become zero, rare n-grams have none."""
    r = random.Random(seed)
    made = [_variation(r) for _ in range(train + train // 3)]
    families = (*TEMPLATES, "unknown")
    seen: dict[str, int] = {}
    for text, _ in made[:train]:
        for g in grams(text):
            seen[g] = seen.get(g, 0) + 1
    often = sorted((g for g, n in seen.items() if n >= 4), key=lambda g: (-seen[g], g))[:MOST_FEATURES]
    vocabulary = {g: k for k, g in enumerate(sorted(often))}

    def matrix(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)))
        for i, (text, _) in enumerate(rows):
            x[i, [vocabulary[g] for g in grams(text) if g in vocabulary]] = 1.0
        return x, np.array([families.index(f) for _, f in rows])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(made[:train])
    one, w, b = np.eye(len(families))[y], np.zeros((x.shape[1], len(families))), np.zeros(len(families))
    w_speed, b_speed = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        error = (softmax(x @ w + b) - one) / len(x)
        w_speed = 0.9 * w_speed - rate * (x.T @ error + decay * w)
        b_speed = 0.9 * b_speed - rate * error.sum(axis=0)
        w, b = w + w_speed, b + b_speed
    w[np.abs(w) < 0.05] = 0.0
    held, truth = matrix(made[train:])
    logits = held @ w + b
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
    temperature = min(loss, key=loss.get)
    p = softmax(logits / temperature)
    wrong = (p.argmax(axis=1) != truth) & (p.argmax(axis=1) != len(families) - 1)
    cutoff = float(min(0.8, max([0.5, *p.max(axis=1)[wrong].tolist()])))
    kept = {g: tuple(round(float(v), 6) for v in w[k]) for g, k in vocabulary.items() if w[k].any()}
    return Model(families, kept, tuple(round(float(v), 6) for v in b), temperature, cutoff)


def _values(docs: DataFrame, rows: list[str], names: str) -> DataFrame:
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tag, id, sentences) for every row: its sentences with a licence word."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = F.flatten(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.split(F.regexp_replace(p, r"\s+", " "), SENTENCE_END)))
    found = F.when(text.rlike(ANCHOR), F.filter(split, lambda x: x.rlike(ANCHOR))).otherwise(F.array().cast("array<string>"))
    return docs.select(F.monotonically_increasing_id().alias("tag"), F.col(f"`{id_col}`").alias("id"), found.alias("sentences"))


def classify(found: DataFrame, model: Model | None = None) -> DataFrame:
    """(tag, at, family, probability, containment) of every candidate sentence; family ``unknown`` where it is not confirmed."""
    model = model or fit()
    words = F.regexp_extract_all(ascii_lower(F.col("sentence")), F.lit(WORD), F.lit(0))
    each = found.select("tag", F.posexplode("sentences").alias("at", "sentence")).select("tag", "at", words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    exploded = each.select("tag", "at", F.explode(F.array_union("w", pairs)).alias("gram"))
    table = _values(found, [f"('{g}', array({', '.join(f'{v}D' for v in w)}))" for g, w in model.weights.items()], "gram, weight")
    names = range(len(model.families))
    summed = exploded.join(F.broadcast(table), "gram").groupBy("tag", "at").agg(*[F.sum(F.col("weight")[k]).alias(f"z{k}") for k in names])
    scored = each.select("tag", "at").join(summed, ["tag", "at"], "left")
    z = F.array(*[(F.coalesce(f"z{k}", F.lit(0.0)) + model.bias[k]) / model.temperature for k in names])
    scored = scored.select("tag", "at", z.alias("z")).select("tag", "at", "z", F.array_max("z").alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    scored = scored.select("tag", "at", F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("z", F.col("top")).cast("int")).alias("family"), (F.lit(1.0) / total).alias("probability"))
    rows = [(f, f"{f}#{k}", [g for g in grams(t) if " " in g]) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    templates = _values(found, [f"('{g}', '{f}', '{t}', {len(gs)})" for f, t, gs in rows for g in gs], "gram, family, template, size")
    held = exploded.join(F.broadcast(templates), "gram").groupBy("tag", "at", "family", "template", "size").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("tag", "at", "family").agg(F.max(F.col("n") / F.col("size")).alias("containment"))
    joined = scored.join(held, ["tag", "at", "family"], "left").select("tag", "at", "family", "probability", F.coalesce("containment", F.lit(0.0)).alias("containment"))
    sure = (F.col("family") != "unknown") & (F.col("probability") >= model.cutoff) & (F.col("containment") >= CONFIRM)
    return joined.withColumn("family", F.when(sure, F.col("family")).otherwise(F.lit("unknown")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, ``licenses``, ``n_licensed``, ``n_unknown``, ``n_candidates``) for every row; ``licenses`` are its confirmed families, sorted."""
    found = staged(candidates(docs, id_col, text_col), "sentences")
    judged = classify(found.filter(F.size("sentences") > 0), model)
    known = F.when(F.col("family") != "unknown", F.col("family"))
    per = judged.groupBy("tag").agg(F.array_sort(F.collect_set(known)).alias("licenses"), F.count(known).alias("n_licensed"), F.count_if(F.col("family") == "unknown").alias("n_unknown"))
    return found.join(per, "tag", "left").select(
        F.col("id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.size("sentences").cast("long").alias("n_candidates"),
    )
