import math
import random

import numpy as np

from quillstream.llm import license_scan as L
from tests.llm.helpers import awkward, docs, words

#: Frames that neither training nor calibration has.
UNSEEN = ("Shared under the terms of {}", "You may use it under the {}.", "Code is offered under {}", "Everything here is under the {}")


def brute(rows):
    model, out = L.trained(), []
    cues = set(model.cues())
    for i, text in rows:
        if text is None:
            continue
        for k, line in enumerate(L.paragraphs(text.lower())):
            if not cues & set(L.tokens(line)):
                continue
            z = L.logits(model, line)
            top = max(z)
            label = L.LABELS[z.index(top)]
            if label == "none":
                continue
            p = round(1 / sum(math.exp((v - top) / (L.SCALE * model.temperature)) for v in z), 6)
            family = label if p >= L.LEAST_PROBABILITY else "unknown"
            have = set(L.grams(L.tokens(line)))
            shapes = [set(L.grams(L.tokens(t))) for t in L.templates(family)] if family != "unknown" else []
            share = round(max([len(have & t) / len(t) for t in shapes], default=0.0), 6)
            out.append((str(i), k, family, p, share, share >= L.CONFIRM))
    return sorted(out)


def test_expressions_against_the_model(spark):
    rng = random.Random(10)
    rows = awkward(rng)
    lines = [t for k in L.FAMILIES for t in L.templates(k)] + list(L.NONE)
    for k in range(60):
        part = [" ".join(words(rng, rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        part.insert(rng.randint(0, len(part)), rng.choice(lines))
        rows.append((100 + k, rng.choice(["\n", "\n", " \t\r\n", "\n\n"]).join(part)))
    rows += [(300, "Licensed " * 3000), (301, "rights"), (302, "All rights reserved.\n\nALL RIGHTS RESERVED."), (None, "Released under the MIT License.")]
    got = sorted((str(r.doc_id), r.para, r.family, r.probability, r.template_share, r.confirmed) for r in L.scan_licenses(docs(spark, rows)).collect())
    want = brute(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_statements_in_frames_that_were_not_learned():
    model = L.trained()
    right = total = 0
    for label, names in L.NAMES.items():
        for frame in UNSEEN:
            for name in names:
                z = L.logits(model, frame.format(name))
                total += 1
                right += L.LABELS[int(np.argmax(z))] == label
    assert right / total > 0.95, right / total
    texts, _ = L.statements(UNSEEN, 99, 1)
    scored = [t for t in texts if int(np.argmax(L.logits(model, t))) != len(L.LABELS) - 1]
    cues = set(model.cues())
    assert len(scored) > 500 and all(cues & set(L.tokens(t)) for t in scored)  # no statement is left unscored


def test_families_and_lines_of_none(spark):
    lines = {
        "this is all licensed under CC BY-NC 4.0.": "cc-by-nc", "Provided under Apache 2.0": "apache-2.0", "SPDX: BSD-3-Clause": "bsd-3-clause", "Available under CC0 1.0": "cc0", "Covered by MPL 2.0": "mpl-2.0",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.': "mit", "Copyright 2021 Jane Doe": "unknown", "Distributed under the Glorbnitz Public License": "unknown", "Available under MIT terms": "mit", "Released under MIT": "mit",
        "the driving license was lost": None, "Apache helicopters flew": None, "Er geht mit uns": None, "She walked under the tree": None, "He was available for terms of two years": None,
    }
    got = {r.para: r.family for r in L.scan_licenses(docs(spark, [(1, "\n\n".join(lines))])).collect()}
    assert got == {2 * k: v for k, v in enumerate(lines.values()) if v}


def test_wrapped_statements_are_one_paragraph(spark):
    text = "My program\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the Software), \nto deal in the Software without restriction.\nEnd."
    (row,) = L.scan_licenses(docs(spark, [(1, text)])).collect()
    assert (row.para, row.family, row.confirmed, row.template_share) == (2, "mit", True, 1.0)


def test_chains_of_any_length(spark):
    chain = "-".join(f"b{k % 10}" for k in range(200_000))
    rows = [(1, "licensed " + chain), (2, chain + " licensed under the MIT License"), (3, "." * 200_000 + "-" * 200_000), (4, " " * 300_000 + "x"), (5, "a" * 300_000 + "\n" + "b" * 100)]
    got = {r.doc_id: r.family for r in L.scan_licenses(docs(spark, rows)).collect()}
    assert got.pop(2) == "mit" and set(got) <= {1}


def test_only_spark_functions(spark):
    plan = L.scan_licenses(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert L.scan_licenses(docs(spark, [])).collect() == []
