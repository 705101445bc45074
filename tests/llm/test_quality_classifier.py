"""The whole verdict against plain perplexities and quantiles."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_lm_scoring import history, plain_model, words

from tallyhouse.llm import kneser_ney, quality_classifier
from tallyhouse.llm.quality_classifier import quality_verdicts


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_quantiles(spark, order):
    random.seed(4)
    common = [f"w{i}" for i in range(60)]
    docs = [(i, random.choice(["en", "fr", None]), " ".join(random.choices(common, k=random.randint(3, 30)))) for i in range(160)]
    docs += [(500 + i, "xx", " ".join(random.choices(common, k=8))) for i in range(6)] + [(900, "en", None), (901, "fr", ""), (None, "en", "w1 w2"), (3, "en", docs[3][2])]
    docs += [(700 + i, "en", " ".join(f"odd{random.random()}" for _ in range(12))) for i in range(5)]
    labels = [(i, 1, 0) for i in range(150)] + [(500 + i, 1, 0) for i in range(6)] + [(7, 0, 0), (8, 1, 1), (9, 1, None), (None, 1, 0), (10, None, 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    quantile, least = 0.9, 10
    got = [tuple(r) for r in quality_verdicts(d, lab, quantile=quantile, least=least, order=order).collect()]

    trusted = {k for k, q, t in labels if k is not None} - {7, 8}  # a null beside another label says nothing
    learns = {r.doc_id for r in spark.createDataFrame([(k,) for k in trusted], "doc_id long").where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 7).collect()}
    _, p = plain_model([t for k, _, t in docs if k in learns], order)
    mean = [(k, lang, len(words(t)), -sum(math.log10(p(*x)) for x in history(words(t))) / len(words(t))) for k, lang, t in docs]

    def at(values):
        return sorted(values)[math.ceil(quantile * len(values)) - 1]

    held = [(lang, x) for k, lang, _, x in mean if k in trusted - learns]
    pooled = at([x for _, x in held])
    of = {lang: [x for own, x in held if own == lang] for lang in {lang for _, lang, _ in docs}}
    # equality by null is a language of its own
    limit = {lang: at(x) if len(x) >= least else pooled for lang, x in of.items()}
    want = [(k, lang, n, 10**x, 10 ** limit[lang], x <= limit[lang] + 1e-12) for k, lang, n, x in mean]

    def order_of(rows):
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2]))

    assert len(got) == len(want) and {len(x) >= least for x in of.values()} == {True, False}
    for a, b in zip(order_of(got), order_of(want)):
        assert a[:3] == b[:3] and a[5] == b[5] and a[3:5] == pytest.approx(b[3:5])
    assert not all(r[5] for r in got) and all(not r[5] for r in got if (r[0] or 0) >= 700 and r[0] < 800)


def test_work_of_a_task_is_bounded(spark, monkeypatch):
    """Tasks train and score on few tokens at once, and the bounded model does not grow with the session's partitions."""
    seen, files = [], []
    chunks, train = kneser_ney.count_parts, quality_classifier.train
    monkeypatch.setattr(kneser_ney, "count_parts", lambda n, most: seen.append(most) or chunks(n, most))
    monkeypatch.setattr(quality_classifier, "train", lambda *a: files.append(meta := train(*a)) or meta)
    docs = spark.createDataFrame([(i, "en", f"w{i % 7} w{i % 5} b") for i in range(40)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 300)
    try:
        quality_verdicts(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [100_000] and files[0]["shards"] == 64
