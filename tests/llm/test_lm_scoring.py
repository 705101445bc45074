"""The model against a plain one in Python, and its defined cases."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from tallyhouse.llm.kneser_ney import discounts
from tallyhouse.llm.lm_scoring import lm_scores

TEXTS = ["the cat sat on the mat", "the cat ate the rat", "a rat sat", "", None, "The CAT sat\ton the hat", "zebra quagga", "the cat sat on the mat", "x " * 300, "the the the cat"]


def words(text):
    return [*(text or "").encode().lower().split(), None]


def plain_model(texts, order=2):
    """(counts of words, probability of a token after two others) by the definition, of a list of texts."""
    counts, pairs, triples = Counter(), Counter(), Counter()
    for text in texts:
        t = words(text)
        counts.update(t)
        pairs.update(zip(["begin", *t[:-1]], t))
        triples.update(history(t))
    if order == 3:  # below the top, the number of words before a bigram stands for its count
        pairs = Counter((a, b) for _, a, b in triples)
    by_two, by_context, before = defaultdict(list), defaultdict(list), Counter()
    for (z, a, _), c in triples.items():
        by_two[z, a].append(c)
    for (a, b), c in pairs.items():
        by_context[a].append(c)
        before[b] += 1
    top, high, low = (discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (triples, pairs, before))
    spread = sum(low[min(c, 3) - 1] for c in before.values()) / len(pairs)

    def over(d, c, others, below):
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(others) + sum(d[min(x, 3) - 1] for x in others) / sum(others) * below

    def p(z, a, b):
        one = (before[b] - (low[min(before[b], 3) - 1] if before[b] else 0)) / len(pairs) + spread / (len(counts) + 1)
        two = over(high, pairs[a, b], by_context[a], one) if a in by_context else one
        return over(top, triples[z, a, b], by_two[z, a], two) if order == 3 and (z, a) in by_two else two

    return counts, p


def history(t):
    """Each token of a text with the two before it."""
    before = ["begin", *t[:-1]]
    return list(zip(["first", *before[:-1]], before, t))


def brute(rows, order=2):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    counts, p = plain_model([t for k, t in rows if not held[k]], order)
    n, v = sum(counts.values()), len(counts)
    for context in (("begin", b"the"), (b"the", b"cat"), ("first", "begin")):
        assert sum(p(*context, w) for w in counts) + p(*context, b"never seen") == pytest.approx(1)
    return {k: (held[k], len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(*x)) for x in history(t))) for k, t in ((k, words(t)) for k, t in rows)}


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order):
    rows = list(enumerate(TEXTS * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scores(df, order=order).collect()}
    want = brute(rows, order)
    assert any(x[0] for x in want.values()) and not all(x[0] for x in want.values())
    for k, (held, n, known, tokens, base, own) in want.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own)


def test_more_shards_change_nothing(spark, monkeypatch):
    from tallyhouse.llm import kneser_ney

    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 40)
    rows = list(enumerate(TEXTS * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kneser_ney.corpus_shards(df) > 40
    assert {r.doc_id: r.score for r in lm_scores(df).collect()} == pytest.approx({k: x[-1] for k, x in brute(rows).items()})


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(empty).collect() == [] and lm_scores(empty, order=3).collect() == []
    with pytest.raises(ValueError):
        lm_scores(empty, order=4)
    odd = spark.createDataFrame([(None, None, 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, score int")
    rows = lm_scores(odd).collect()
    assert len(rows) == 3 and {r.n_tokens for r in rows} == {1, 3} and not any(r.held_out for r in rows if r.doc_id is None)


def test_a_missing_file_is_an_error(spark):
    import os

    from tallyhouse.llm.kneser_ney import score, train

    df = spark.createDataFrame([(i, f"w{i} w{i + 1} the w{i % 3}") for i in range(40)], "doc_id long, text string")
    meta = train(df)
    assert score(df, meta).count() == 40
    one = next(f for f in sorted(os.listdir(meta["folder"])) if f.startswith("shard-"))
    os.rename(f"{meta['folder']}/{one}", f"{meta['folder']}/moved")
    with pytest.raises(Exception, match="is not there"):
        score(df, meta).collect()
