"""The licence classifier against plain Python, recall of held-out templates, its defined cases, and a plan without Python."""

import math

import pytest

from tallyhouse.llm.license_scan import CONFIRM, LEAST_PAIRS, UNKNOWN, gains, license_paragraphs, template_pairs, template_words, train
from tallyhouse.llm.license_texts import PARAGRAPHS

PROSE = ["We walked to the river, and the others came later.", "Er sprach mit ihr und mit uns.", "The house by the window was sold in the year of the flood.", "Nine of the carts were green and the rest were made of stone.", "It is not known who wrote this part of the letter."]


@pytest.fixture(scope="module")
def model(spark):
    corpus = [(i, "\n".join(PROSE[(i + k) % 5] for k in range(i % 4 + 1))) for i in range(300)]
    return train(spark.createDataFrame(corpus, "doc_id long, text string"))


def brute(text, model):
    """(first, last, family, probability, similarity) of the paragraphs of a text, by plain loops."""
    weights, families, t = dict(model["rows"]), model["families"], model["temperature"]
    pairs: dict = {}
    for f, i, _, p in template_pairs():
        pairs.setdefault((f, i), set()).add(p)
    lines = text.split("\n")
    short = [len(x) <= 100 and any(c.isascii() and c.isalnum() for c in x) for x in lines]
    units = [(i, i, x) for i, x in enumerate(lines)]
    at = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip("\t\n\v\f\r "):
            if i - at > 1:
                units.append((at, i - 1, " ".join(lines[at:i])))
            for s in range(at, i, 3) if i - at > 6 else ():
                own = [k for k in range(s, min(s + 6, i)) if short[k]]
                if len(own) > 1:
                    units.append((own[0], own[-1], " ".join(lines[k] for k in own)))
            at = i + 1
    out = []
    for first, last, line in units:
        w = template_words(line)
        two = {f"{a} {b}" for a, b in zip(w, w[1:])}
        z = [round(b + sum(weights[g][i] for g in {*w, *two} if g in weights), 9) for i, b in enumerate(model["intercepts"])]
        e = [math.exp((x - max(z)) / t) for x in z]
        p = dict(zip(families, [x / sum(e) for x in e]))
        if p[UNKNOWN] < 0.5:
            best = max((f for f in families if f != UNKNOWN), key=lambda f: (p[f], -families.index(f)))
            family = best if p[best] > model["least"] else UNKNOWN
            alike = {k: round(min(1.0, len(ps & two) / max(LEAST_PAIRS, min(len(ps), len(two)))), 6) for k, ps in pairs.items()}
            sim, other = max((x for (f, _), x in alike.items() if f == family), default=0.0), max((x for (f, _), x in alike.items() if f != family), default=0.0)
            if sim == other == 0:
                continue
            if sim == 0 or sim < CONFIRM <= other:
                family, sim = UNKNOWN, 0.0
            out.append((first, last, family, round(p[best], 6), sim, sim >= CONFIRM and sim >= other))
    return out


def test_against_plain_python(spark, model):
    texts = [p for ps in PARAGRAPHS.values() for p in ps]
    texts += ["\n".join(t[i:i + 70] for i in range(0, len(t), 70)) for t in texts[:12]]
    many = " ".join(texts[:4]).split()
    texts.append("\n".join(" ".join(many[i:i + 9]) for i in range(0, len(many), 9)))
    texts += [" ".join(PROSE) + "\n" + texts[3] + "\n\n" + PROSE[0], "Released under GPLv3\nor the MIT licence", *PROSE]
    rows = [(i, t) for i, t in enumerate(texts)]
    found: dict = {}
    for r in license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        found.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.probability, r.similarity, r.confirmed))
    for i, t in rows:
        want = brute(t, model)
        every = {(a, f, p, s, ok) for a, _, f, p, s, ok in want}
        assert set(found.get(i, [])) <= every
        spans = [(a, b, f) for a, b, f, _, _, ok in want if a < b and ok and f != UNKNOWN]
        for a, b, f, p, s, ok in want:  # each line that is confirmed, or within no span, is there
            if a == b and (ok or not any(x <= a and a <= y for x, y, _ in spans)):
                assert (a, f, p, s, ok) in found.get(i, [])
        if want and not any(a == b for a, b, *_ in want) and spans:
            assert {f for _, f, *_ in found[i]} & {f for *_, f in spans}
    assert any(b - a > 6 for t in texts for a, b, *_ in brute(t, model))  # a long run is one paragraph


def test_recall(spark, model):
    assert model["recall"] >= 0.9  # templates that the calibrating model had not seen
    lines = [(k, p) for k, ps in PARAGRAPHS.items() for p in ps]
    got = {r.doc_id: (r.family, r.confirmed) for r in license_paragraphs(spark.createDataFrame(list(enumerate(p for _, p in lines)), "doc_id long, text string"), model).collect()}
    assert sum(got.get(i) == (k, True) for i, (k, _) in enumerate(lines)) >= 0.95 * len(lines)
    plain = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert not [r for r in license_paragraphs(plain, model).collect() if r.family != UNKNOWN]


def test_screen_is_an_upper_bound(model):
    """No n-gram's gain is beyond its level's, and every n-gram with a gain has a level."""
    levels, lack = gains(model)
    u = model["families"].index(UNKNOWN)
    level = {g: v for v, gs in levels for g in gs}
    for g, w in model["rows"]:
        gain = max(x - w[u] for i, x in enumerate(w) if i != u)
        assert gain <= level.get(g, 0.0) + 1e-12
    assert lack > 0


def test_cases(spark, model):
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"Some prose.\n{mit}\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, PROSE[0]), (4, None), (5, ""), (6, "no such words"), (None, "All rights reserved."), (None, "All rights reserved."), (7, f"{apache}\n{gpl}"), (8, "x " * 200_000 + mit), (9, "\n" * 2000 + mit)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, family string, row int")
    out = license_paragraphs(df, model)
    got = sorted((str(r.doc_id), r.paragraph, r.family, r.confirmed) for r in out.collect())
    assert got == [("1", 1, "mit", True), ("2", 0, "cc-by-nc", True), ("7", 0, "apache-2.0", True), ("7", 1, "gpl", True), ("8", 0, "mit", True), ("9", 2000, "mit", True), ("None", 0, "proprietary", True), ("None", 0, "proprietary", True)]
    assert license_paragraphs(df.limit(0), model).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_wrapped_and_lower_case(spark, model):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the\nSoftware without restriction."
    rows = [(1, "Some prose.\n\n" + wrapped + "\n\nMore."), (2, "Released under GPLv3"), (3, "Released under LGPLv2.1"), (4, "apache-2.0"), (5, "released under gpl v2"), (6, "released under the mit license"), (7, "if a copy of the mpl was not distributed with this file, you can obtain one"), (8, f"{PROSE[0]}\nThat was it."), (9, "in no event shall the authors be liable for any claim, damages or other liability"), (10, "Some prose.\n" + wrapped + "\nMore.")]
    got: dict = {}
    for r in license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        if r.family != UNKNOWN:
            got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {1: {"mit"}, 2: {"gpl"}, 3: {"lgpl"}, 4: {"apache-2.0"}, 5: {"gpl"}, 6: {"mit"}, 7: {"mpl-2.0"}, 9: {"mit"}, 10: {"mit"}}


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert license_paragraphs(df).collect() == []


def test_runs_of_any_width(spark, model):
    """A paragraph of many long lines is seen whole, and does not run over a blank line."""
    grant = next(p for p in PARAGRAPHS["mit"] if p.startswith("Permission"))
    words = grant.split()
    narrow, wide = "\n".join(words), "\n".join(" ".join(words[i:i + 25]) for i in range(0, len(words), 25))
    rows = [(1, f"{PROSE[0]}\n\n{narrow}\n\n{PROSE[1]}"), (2, f"{PROSE[0]}\n \t\n{wide}\n\n{PROSE[1]}"), (3, "\n".join(PROSE * 40))]
    got = {r.doc_id: (r.paragraph, r.family, r.confirmed) for r in license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() if r.family != UNKNOWN}
    assert got[1] == (2, "mit", True) and got[2][1:] == ("mit", True) and 3 not in got


def test_lookalikes(spark, model):
    rows = [(1, "Er kam mit ihr."), (2, "Sie fuhr mit dem Wagen, und wir gingen mit den anderen."), (3, "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.")]
    got = [(r.doc_id, r.family, r.confirmed) for r in license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() if r.family != UNKNOWN]
    assert got == [(3, "wtfpl", True)]


def test_german_prose_has_no_family(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = license_paragraphs(docs).collect()
    assert out and all(r.confirmed or r.family == UNKNOWN for r in out)


def test_model_is_saved(spark, model, tmp_path):
    from tallyhouse.llm.license_scan import load_model, save_model

    save_model(model, spark, f"{tmp_path}/model")
    again = load_model(spark, f"{tmp_path}/model")
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, PROSE[0])], "doc_id long, text string")
    assert license_paragraphs(df, again).collect() == license_paragraphs(df, model).collect() != []
