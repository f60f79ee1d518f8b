"""Licence scan: a trained paragraph classifier, written out as Spark expressions.

A sparse multinomial logistic regression over word unigrams and bigrams is trained
in numpy on the driver from statements and their variations. Its weights, as whole
thousandths, become literals; scoring, calibration and the comparison with
templates are DataFrame functions without a shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import project

#: Sentences of licence families.
SENTENCES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "This work is released into the public domain, no rights reserved, CC0 1.0 Universal license", "No rights reserved."),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "This document is confidential and proprietary; no license is granted, all rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced without prior written permission of the publisher.",
    ),
    "unknown": (
        "Use is governed by the license agreement.", "See the LICENSE file for terms.", "Copyright 2021 Jane Doe", "Copyright (c) 2019 The Authors", "Copyright 2004-2010 Example Project contributors",
        "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted.",
    ),
}
#: Names of licences, the first words of each family's statements.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0", "Apache License"),
    "mit": ("MIT License", "MIT", "MIT licence", "MIT terms", "MIT/X11 License"),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD License", "BSD-3-Clause", "3-clause BSD License", "New BSD License", "BSD terms", "BSD 3-Clause"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3", "GPLv3", "GPL-3.0-or-later", "GPL-3.0", "GNU GPL", "GPL"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL", "LGPL-2.1", "LGPLv3", "GNU LGPL"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License", "MPL"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "CC BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"),
    "cc0": ("CC0 1.0", "CC0-1.0", "CC0", "CC0 1.0 Universal"),
    "unknown": (
        "Eclipse Public License 2.0", "EPL-2.0", "Artistic License", "Boost Software License", "Unlicense license", "SIL Open Font License, Version 1.1", "zlib License", "Community Data License Agreement",
        "Microsoft Public License", "European Union Public Licence", "license of the vendor", "usual license", "Open Database License", "Python Software Foundation License", "Frobnicate Public License",
    ),
}
#: Frames of statements: those that are learned from, and those that probabilities are calibrated on.
FRAMES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}", "Distributed under the {}.", "Distributed under {}", "Available under the {}", "Available under {}",
    "This work is licensed under the {}.", "This file is available under the terms of the {}.", "License: {}", "SPDX-License-Identifier: {}", "Covered by {}", "Subject to the terms of the {}.", "Use of it is governed by the {}.",
)
CALIBRATION = ("Provided under {}", "Published under the {}.", "SPDX: {}", "Made available under the {}", "This project uses the {}.", "It is dual-licensed under {}.", "Its terms are those of the {}")
#: Lines that state no licence.
NONE = (
    "He renewed his driving license last week.", "The license plate was missing.", "Human rights are universal.", "She asked for permission to leave the room.", "The warranty covers two years.",
    "Copyright law was the subject of the lecture.", "They fought for civil rights.", "A fishing licence costs ten dollars.", "He was licensed to practise medicine in the state.", "The public domain of letters grew.",
    "Turn left at the rights office.", "Permission to enter was refused at the gate.", "The redistribution of wealth was debated.", "The source of the river was found by this general.", "All of the papers were reserved for later.",
    "Apache helicopters flew over the hills.", "The Apache people lived there.", "He studied at MIT for two years.", "Er kam mit dem Zug nach Hause.", "Sie sprach mit ihm und mit den Kindern.", "The limit was committed to paper.",
    "The Mozilla foundation met.", "The BSD kernel booted.", "Kaffee mit Milch.", "Attribution of the painting is in doubt.", "Proprietary methods were used in the study.", "They talked under the tree about the terms of trade.",
    "Software is provided by the vendor.", "The tables were reserved for guests.", "Creative people met in the commons.", "Common conditions of work were met.", "The program was released in May.", "Available rooms are listed below.", "A gnu grazed on the plain.",
    "The driving license was lost.", "His license expired in June.", "The license fee was raised.", "Poetic license explains the ending.",
    "The cat hid under the table.", "Under the bridge ran water.", "He sat under the old oak and read.", "They were under the impression that it rained.", "Prices fell under the new government.",
)
#: Frequent words of several languages.
FREQUENT = (
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these "
    "would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know "
    "der die das und ist nicht ein eine von zu den mit auf für im dem des sich le la les de des et un une est que en du dans qui pour pas sur au el los las una por con para se al lo su como "
)
#: Words of statements that stand elsewhere, too, and say nothing apart from their neighbours.
LOOSE = (("mit", "apache", "bsd", "mpl", "mozilla", "gnu"), ("attribution", "proprietary", "under", "terms", "available", "released", "distributed", "version", "work", "public", "general", "software", "rights", "permission", "free", "covered", "subject", "source", "2.0", "4.0", "3", "international"))
_LETTERS = "[a-z0-9\u00c0-\u1fff\u2c00-\U0010ffff]"
#: Possessive, so that no engine's stack grows with a word.
WORDS = rf"{_LETTERS}++(?:[.-]{_LETTERS}++)*+"
FAMILIES = tuple(k for k in SENTENCES if k != "unknown")
LABELS = (*FAMILIES, "unknown", "none")
SCALE = 1000
#: Steps of training, and the pull of each one's weights to zero.
STEPS, SHRINK = 120, 1e-4
#: A paragraph is scored if one of its words, none of FREQUENT, alone speaks for some licence by so much more than for none, in thousandths.
CUE = 600
#: Share of a template's words and pairs of words that a paragraph has to hold for a prediction to be confirmed.
CONFIRM = 0.6
#: Calibrated probability under which a licence statement is of the unknown class.
LEAST_PROBABILITY = 0.5
#: A line of so many characters that ends with neither a stop nor a blank goes on in the next one, unless that is empty.
WRAP, STOPS = 40, ".!?:;"


def templates(family: str) -> list[str]:
    """What a statement of a family is compared with: its sentences, and its names in the frames that are learned from."""
    return [*SENTENCES.get(family, ()), *(f.format(n) for f in FRAMES for n in NAMES.get(family, ()))]


def tokens(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def paragraphs(text: str) -> list[str]:
    """Lines, those that were wrapped joined again."""
    out: list[str] = []
    soft = False
    for line in re.sub(r"(?<![ \t\r])[ \t\r]++\n", "\n", text).split("\n"):
        if soft and line:
            out[-1] += " " + line
        else:
            out.append(line)
        soft = len(line) >= WRAP and line[-1] not in STOPS + " \t\r"
    return out


def varied(line: str, filler: list[str], rng: np.random.Generator) -> str:
    """A line with words lost, and with words before and after it."""
    words = [w for w in line.split() if rng.random() > 0.06] or line.split()
    add = [filler[i] for i in rng.integers(len(filler), size=int(rng.integers(0, 8)))]
    at = int(rng.integers(0, len(add) + 1))
    return " ".join([*add[:at], *words, *add[at:]])


def statements(frames: tuple[str, ...], seed: int, copies: int) -> tuple[list[str], np.ndarray]:
    """Labelled paragraphs: names in frames, sentences, and lines of none, each as it is and varied `copies` times."""
    rng = np.random.default_rng(seed)
    filler = FREQUENT.split()
    texts, labels = [], []
    for k, label in enumerate(LABELS):
        lines = [*SENTENCES.get(label, ()), *(f.format(n) for f in frames for n in NAMES.get(label, ())), *(NONE if label == "none" else ())]
        for line in lines:
            texts += [line, *(varied(line, filler, rng) for _ in range(copies))]
            labels += [k] * (copies + 1)
    for _ in range(len(texts)):  # frequent words, and among them some of those that say nothing alone
        words = [filler[i] for i in rng.integers(len(filler), size=int(rng.integers(2, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(words) + 1))
            some = LOOSE[int(rng.integers(len(LOOSE)))]
            words[at:at] = [some[int(rng.integers(len(some)))], filler[int(rng.integers(len(filler)))]]
        texts.append(" ".join(words))
        labels.append(len(LABELS) - 1)
    return texts, np.array(labels)


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, list[int]]
    bias: list[int]
    temperature: float

    def cues(self) -> list[str]:
        """Words that alone speak for some licence."""
        often = set(FREQUENT.split())
        return sorted(g for g, v in self.vocabulary.items() if " " not in g and g not in often and max(v[:-1]) - v[-1] >= CUE)


@cache
def trained() -> Model:
    """Proximal gradient steps with momentum keep the weights sparse; the temperature is fitted on frames not learned from."""
    texts, y = statements(FRAMES, 1, 2)
    names: dict[str, int] = {}
    rows = [[names.setdefault(g, len(names)) for g in grams(tokens(t))] for t in texts]
    x = np.zeros((len(texts), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    hot = np.eye(len(LABELS), dtype=np.float32)[y]
    w, b, rate = np.zeros((x.shape[1], len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32), 1.0
    ahead, before = w, w
    for step in range(STEPS):
        z = x @ ahead + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hot) / len(x)
        w = ahead - rate * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0)
        ahead = w + step / (step + 3) * (w - before)
        before = w
        b = b - rate * d.sum(axis=0)
    whole = np.rint(w * SCALE).astype(int)
    vocabulary = {g: whole[i].tolist() for g, i in names.items() if whole[i].any()}
    model = Model(vocabulary, np.rint(b * SCALE).astype(int).tolist(), 1.0)
    texts, y = statements(CALIBRATION, 2, 1)
    z = np.array([logits(model, t) for t in texts]) / SCALE

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    return Model(vocabulary, model.bias, min((round(0.3 + 0.05 * k, 2) for k in range(60)), key=loss))


def logits(model: Model, text: str) -> list[int]:
    out = list(model.bias)
    for g in grams(tokens(text)):
        for k, v in enumerate(model.vocabulary.get(g, ())):
            out[k] += v
    return out


def constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, para, family, probability, template_share, confirmed), one for each licence statement.

    Paragraphs are the lines of a text, counted from 0, wrapped ones joined: a line of
    WRAP characters that ends with none of STOPS goes on in the next one. Each one is
    classified that holds a word of Model.cues; those of the class none are left out. A family whose
    calibrated probability is under LEAST_PROBABILITY becomes unknown. template_share
    is the largest share of one of the family's templates' words and pairs of words that the paragraph
    holds, and confirmed tells that it reaches CONFIRM; for unknown it is 0. Null and
    empty texts have no paragraphs. Texts of any length are scanned whole; repeated rows are reported
    each; a null doc_id is kept; an empty table gives no rows.
    """
    model = trained()
    rows = project(docs, doc_id="bigint", text="string")
    text = F.regexp_replace(F.lower("text"), r"(?<![ \t\r])[ \t\r]++\n", "\n")
    text = F.regexp_replace(text, rf"\n(?<=[^\n]{{{WRAP - 1}}}[^\n{STOPS} \t\r]\n)(?=[^\n])", " ")
    rows = rows.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("para", "line"))
    # generators keep what they yield from being computed again in filters
    rows = rows.select("doc_id", "para", F.explode(F.array(F.regexp_extract_all("line", F.lit(f"({WORDS})"), F.lit(1)))).alias("words"))
    rows = rows.where(F.exists("words", lambda w: w.isin(model.cues())))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size("words") - 1, F.lit(0)))
    rows = rows.select("doc_id", "para", F.explode(F.array(F.array_distinct(F.concat("words", pairs)))).alias("grams"))
    hits = F.filter("grams", lambda g: g.isin(list(model.vocabulary)))
    table = constant(model.vocabulary, "map<string,array<int>>")
    zero = constant(model.bias, "array<int>")
    score = F.aggregate(hits, zero, lambda a, g: F.zip_with(a, F.try_element_at(table, g), lambda x, y: x + y))
    rows = rows.select("doc_id", "para", "grams", F.explode(F.array(score)).alias("scores"))
    names = constant(list(LABELS), "array<string>")
    best = F.array_position("scores", F.array_max("scores"))
    share = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - F.array_max("scores")) / F.lit(SCALE * model.temperature)))
    rows = rows.select("doc_id", "para", "grams", F.element_at(names, best.cast("int")).alias("label"), F.round(1 / share, 6).alias("probability"))
    rows = rows.where("label <> 'none'")
    family = F.when(F.col("probability") >= LEAST_PROBABILITY, F.col("label")).otherwise("unknown")
    rows = rows.withColumn("family", family)
    shapes = constant({k: [grams(tokens(t)) for t in templates(k)] for k in FAMILIES}, "map<string,array<array<string>>>")
    fit = F.transform(F.try_element_at(shapes, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    fit = F.round(F.coalesce(F.array_max(fit), F.lit(0.0)), 6)
    return rows.select("doc_id", "para", "family", "probability", fit.alias("template_share"), (fit >= CONFIRM).alias("confirmed"))


def oracle_sql() -> str:
    """The same in SQL; the weights of the trained model are values of a table."""
    model = trained()

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def listed(xs: list[str]) -> str:
        return "[" + ", ".join(map(quoted, xs)) + "]"

    weights = ", ".join(f"({quoted(g)}, {k}, {v})" for g, row in model.vocabulary.items() for k, v in enumerate(row) if v)
    bias = ", ".join(f"({k}, {quoted(n)}, {v})" for k, (n, v) in enumerate(zip(LABELS, model.bias, strict=True)))
    shapes = ", ".join(f"({quoted(k)}, {listed(grams(tokens(t)))})" for k in FAMILIES for t in templates(k))
    return rf"""
with weight(gram, k, w) as (values {weights}),
label(k, name, w) as (values {bias}),
shape(family, t) as (values {shapes}),
s as (
  select doc_id, string_split(regexp_replace(lower(text), '[ \t\r]+\n', chr(10), 'g'), chr(10)) as parts from documents where text is not null),
l as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from s),
b as (
  select *, lag(line) over (partition by doc_id order by pos) as prior from l),
n as (
  select doc_id, pos, line, sum(case when line <> '' and length(prior) >= {WRAP} and not regexp_matches(prior, '[{STOPS} \t\r]$') then 0 else 1 end) over (partition by doc_id order by pos) - 1 as para from b),
p as (
  select doc_id, para, regexp_extract_all(string_agg(line, ' ' order by pos), '{WORDS.replace("++", "+").replace("*+", "*")}') as words from n group by doc_id, para),
g as (
  select doc_id, para, list_distinct(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams
  from p where list_has_any(words, {listed(model.cues())})),
h as (
  select doc_id, para, unnest(grams) as gram from g),
z as (
  select doc_id, para, k, sum(w)::bigint as w from h join weight using (gram) group by doc_id, para, k),
e as (
  select g.doc_id, g.para, label.k, label.name, label.w + coalesce(z.w, 0) as score
  from g cross join label left join z on z.doc_id = g.doc_id and z.para = g.para and z.k = label.k),
t as (
  select *, max(score) over (partition by doc_id, para) as top from e),
a as (
  select doc_id, para, arg_min(name, k) filter (where score = top) as name, round(1 / sum(exp((score - top) / {SCALE * model.temperature})), 6) as probability
  from t group by doc_id, para),
f as (
  select doc_id, para, case when probability >= {LEAST_PROBABILITY} then name else 'unknown' end as family, probability from a where name <> 'none'),
c as (
  select f.doc_id, f.para, f.family, f.probability, round(coalesce(max(len(list_intersect(t, grams)) / len(t)), 0), 6) as template_share
  from f join g using (doc_id, para) left join shape using (family) group by all)
select doc_id, para::int as para, family, probability, template_share, template_share >= {CONFIRM} as confirmed from c"""
