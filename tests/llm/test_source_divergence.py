"""Source divergence against exact sums in plain Python, and its defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import source_divergence as sd
from tallyhouse.llm.source_divergence import probability, source_divergence, terms

SCHEMA = "doc_id long, text string, lang string, source string, item string, value int, slice int, n string"


def plain_terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(rows, least, top):
    count, total, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, found = lang or "", source or "", plain_terms(text or "")
        groups.add((lang, source))
        count[lang, source].update(found)
        total[lang].update(found)
        held[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t in total[lang] if held[lang][t] >= least]

        def p(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        mine, q = p(count[lang, source]), p(total[lang])
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                theirs = p(count[lang, other])
                pairs.append((other, sum(abs(mine[t] - theirs[t]) for t in kept)))
        more = [(t, mine[t] - q[t]) for t in kept if count[lang, source][t] and mine[t] > q[t]]
        for part, found in (("pair", pairs), ("term", more)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("block,slice_terms,top", [(128, 1000, 50), (3, 7, 4), (1, 5, 3)])
def test_against_plain_sums(spark, block, slice_terms, top, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_TOKENS", 200)
    random.seed(block)
    words = ["Ab", "aB", "é", "É", "x1y", "don't", "ß", "日本", "z", "zz", "q-r", "İ"] + [f"w{chr(97 + i)}" for i in range(30)]
    rows = [(i, " ".join(random.choices(words[: 10 + i % 30], k=random.randint(0, 30))), random.choice(["en", "en", "de", None, "xx"]), random.choice(["s1", "s2", "é", None, "S3", "s4", "hot", "hot", "hot"])) for i in range(400)]
    rows += rows[:20] + [(None, None, "en", "s9"), (500, "", "fr", "a"), (501, None, "fr", "b"), (502, "rare", "one", "alone"), (503, "ab " * 5000, "en", "long")]
    rows = [(*r, "item", 1, 2, "n") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = source_divergence(df, least=3, top=top, block=block, slice_terms=slice_terms).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows, 3, top)


def test_every_two_blocks_meet_once():
    for blocks in range(1, 12):
        met = Counter()
        for r in range(blocks // 2 + 1):
            for b in range(blocks):
                host = (b - r) % blocks
                if blocks > 2 * r or (blocks == 2 * r and host < r):
                    met[frozenset((host, b))] += 1
        assert met == Counter({frozenset((i, j)): 1 for i in range(blocks) for j in range(i, blocks)})


def test_probability_is_exact_for_large_counts():
    for n in (0, 7, 9_223_372_031, 10**15, 9 * 10**17):
        assert probability(np.array([n], np.int64), 10**18, 10).tolist() == [1 + 10**9 * (n + 5) // (10**18 + 50)]


def test_terms():
    for text in ("", "A[b]`c{d}~\x7fÉé x\U0001f600", "1a2B3", "\x00\t a\n"):
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    assert source_divergence(spark.createDataFrame([(1, None, None, None, "", 0, 0, "")], SCHEMA)).collect() == []
