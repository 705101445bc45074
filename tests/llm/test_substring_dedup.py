"""Repeated passages against all pairs compared plainly, and the parts of the method against brute force."""

import random

import numpy as np
import pytest

from tallyhouse.llm import substring_dedup
from tallyhouse.llm.substring_dedup import FUNCTIONS, anchors, covered, extents, repeated_passages, run_minima, windows_of


def test_windows():
    random.seed(1)
    for _ in range(200):
        x = np.array([random.randrange(8) for _ in range(random.randint(1, 40))], np.uint64)
        run = random.randint(1, 12)
        want = {min(range(i, i + run), key=lambda p: (x[p], p)) for i in range(len(x) - run + 1)}
        assert set(anchors(x, np.zeros(len(x), np.int64), run).tolist()) == want
        least, starts = run_minima(x, np.zeros(len(x), np.int64), run)
        assert [(min(range(i, i + run), key=lambda p: (x[p], p)), i) for i in range(len(x) - run + 1)] == list(zip(least.tolist(), starts.tolist()))


def test_extents():
    """A window's extent is the union of the runs of which it is least."""
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in range(30)]
    lengths, run = np.array([70, 3, 0, 40]), 12
    found = windows_of(np.arange(4), rng.integers(0, 30, 113), words, lengths, run)
    c, k, span = extents(found["place"], run)
    assert set(k.tolist()) == set(range(FUNCTIONS)) and set(found["rid"].tolist()) == {0, 3}
    for doc, n in ((0, 66), (3, 36)):
        for f in range(FUNCTIONS):
            own = span[(found["rid"] == doc) & (k == f)]
            own = own[np.argsort(own[:, 0])]
            starts = [(a, b - run + 1) for a, b in own.tolist()]
            assert starts[0][0] == 0 and starts[-1][1] == n - run and all(b + 1 == c for (_, b), (c, _) in zip(starts, starts[1:]))


def test_sweep():
    random.seed(2)
    for _ in range(300):
        w = [sorted(random.choices(range(20), k=2)) for _ in range(random.randint(0, 6))]
        kinds = [random.randrange(3) for _ in w]
        got = {p for s, e in covered(np.array(w).reshape(-1, 2), np.array(kinds), 2) for p in range(s, e + 1)}
        assert got == {p for p in range(20) if len({k for (a, b), k in zip(w, kinds) if a <= p <= b}) >= 2}


def grams(ws):
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


@pytest.mark.parametrize(("crowd", "hot"), [(16, 40), (3, 6)])
def test_planted(spark, crowd, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "HOT", hot / substring_dedup.SAMPLE)
    random.seed(3)
    vocabulary = ["the", "of"] * 20 + [f"w{i}" for i in range(400)]

    def prose(n):
        return random.choices(vocabulary, k=n)

    exact, near, short, hot = prose(60), prose(90), prose(40), prose(55)
    docs, has = [], []
    for i in range(160):
        parts, own = [prose(random.randint(0, 80))], set()
        for name, passage, share in (("exact", exact, 0.1), ("near", near, 0.1), ("short", short, 0.1), ("hot", hot, 0.5)):
            if random.random() < share:
                p = list(passage)
                if name == "near":
                    p[random.randrange(20, 70)] = f"x{i}"
                parts += [p, prose(random.randint(0, 80))]
                own.add(name)
        docs.append((i, " ".join(sum(parts, [])).upper() if i % 7 == 0 else " ".join(sum(parts, []))))
        has.append(own)
    license_line = "licensed under the one two three licence version"
    docs += [(1000 + i, " ".join(prose(70)) + "\n" + license_line + "\n" + " ".join(prose(70))) for i in range(30)]
    docs += [(2000, docs[0][1]), (2001, docs[0][1]), (0, docs[0][1]), (None, " ".join(prose(10) + exact)), (3000, None), (3001, ""), (3002, "a b")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, similarity int").repartition(4)
    rows = repeated_passages(df).collect()
    words = {k: (t or "").lower().split() for k, t in docs}
    for r in rows:
        a, b = words[r.doc_id][r.start_word:r.end_word], words[r.rep_doc_id][r.rep_start:r.rep_end]
        x, y = grams(a), grams(b)
        assert len(a) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8 and r.doc_id != r.rep_doc_id
    named = {r.doc_id for r in rows} | {r.rep_doc_id for r in rows}
    assert not any(k is not None and 1000 <= k < 1030 for k in named)
    assert {2000, 2001, 0, None} <= named
    group = {k: k for k in named}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for name, passage in (("exact", exact), ("near", near), ("hot", hot)):
        holders = [i for i in range(160) if name in has[i]]
        group = {k: k for k in named}
        for r in rows:
            own = grams(words[r.doc_id][r.start_word:r.end_word])
            if len(own & grams(passage)) >= 0.5 * min(len(own), len(grams(passage))):
                group[find(r.doc_id)] = find(r.rep_doc_id)
        assert len(holders) > 5 and set(holders) <= named and len({find(k) for k in holders}) == 1, name
    clean = [i for i in range(1, 160) if has[i] <= {"short"}]
    assert clean and not set(clean) & named


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_passages(df).collect() == []
    assert repeated_passages(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(("crowd", "hot"), [(16, 40), (3, 6)])
def test_passage_of_frequent_lines(spark, crowd, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "HOT", hot / substring_dedup.SAMPLE)
    random.seed(6)
    prose = lambda n: [f"v{random.randrange(10 ** 6)}" for _ in range(n)]
    passages = [[[f"p{q}l{i}w{j}" for j in range(9)] for i in range(7)] for q in range(4)]
    docs, holders = [], {}
    for q, lines in enumerate(passages):
        for line, following in zip(lines, [*lines[1:], []]):  # every two lines are far more frequent than the passage
            docs += [(len(docs) + i, " ".join(prose(60) + line + following + prose(60))) for i in range(20)]
        holders[q] = [len(docs), len(docs) + 1]
        docs += [(len(docs) + i, " ".join(prose(60) + sum(lines, []) + prose(60))) for i in range(2)]
    found = {(r.doc_id, r.rep_doc_id) for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    texts = {k: grams(t.split()) for k, t in docs}
    want = {(a, b) for a, x in texts.items() for b, y in texts.items() if a < b and len(x & y) >= 46}
    assert want == {tuple(v) for v in holders.values()}
    assert {tuple(sorted(x)) for x in found} == want


@pytest.mark.parametrize("edits", [0, 1])
def test_recall_against_all_pairs(spark, edits):
    """Every pair of texts that shares a passage, by comparing all pairs of texts plainly, is tied by the result; frequent lines stand around and inside."""
    random.seed(8 + edits)
    prose = lambda n: [f"v{random.randrange(10 ** 6)}" for _ in range(n)]
    lines = [prose(random.randint(8, 24)) for _ in range(12)]
    passages = []
    for i in range(60):
        p = prose(random.randint(50, 90))
        if i % 3 == 0:  # half of it is a frequent line
            p = p[:30] + random.choice(lines) + p[30:]
        passages.append(p)
    docs = []
    for i in range(360):
        text = prose(random.randint(0, 60)) + random.choice(lines)
        for _ in range(random.randint(0, 2)):
            p = list(random.choice(passages))
            for _ in range(edits):
                p[random.randrange(len(p))] = f"e{i}"
            text += p + prose(random.randint(0, 30)) + random.choice(lines)
        docs.append((i, " ".join(text)))
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.rep_doc_id)
        found.setdefault(r.rep_doc_id, set()).add(r.doc_id)

    def reach(k):
        seen, new = {k}, [k]
        while new:
            new = [y for x in new for y in found.get(x, ()) if y not in seen and not seen.add(y)]
        return seen

    sets = {k: [hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)] for k, t in docs for w in [t.split()]}
    want = []
    for a in range(len(docs)):
        own = {g: i for i, g in enumerate(sets[a])}
        for b in range(a + 1, len(docs)):
            if edits == 0:  # a stretch of 46 grams in both
                length = best = 0
                for g, before in zip(sets[b], [None, *sets[b]]):
                    length = length + 1 if g in own and before in own and own[g] == own[before] + 1 else int(g in own)
                    best = max(best, length)
                if best >= 46:
                    want.append((a, b))
            elif len(set(sets[a]) & set(sets[b])) >= 60:
                want.append((a, b))
    reached = {k: reach(k) for k, _ in docs}
    assert len(want) > 300 and sum(b in reached[a] for a, b in want) >= (1.0 if edits == 0 else 0.97) * len(want)


def test_hot_buckets_are_counted_in_all_rows(spark):
    """Exactly the buckets of a hundredth of all rows, whatever the partitions; 59 and 60 of 6,000 rows no sample tells apart."""
    rng = random.Random(12)
    run = 20
    lines = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=26)) for _ in range(12)]
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(26)) for _ in range(6_000)]
    at = iter(rng.sample(range(6_000), 6 * 59 + 6 * 60))
    for k, line in enumerate(lines):
        for i in [next(at) for _ in range(59 + k % 2)]:
            texts[i] = f"{line} {texts[i]} {line}"
    words, codes = {}, []
    for t in texts:
        codes += [words.setdefault(w.encode(), len(words)) for w in t.split()]
    found = windows_of(np.arange(6_000), np.array(codes), list(words), np.array([len(t.split()) for t in texts]), run)
    rows = {}
    for bucket, rid in zip(found["bucket"].tolist(), found["rid"].tolist()):
        rows.setdefault(bucket, set()).add(rid)
    want = sorted(b for b, of in rows.items() if len(of) >= 60)
    assert want and any(len(of) == 59 for of in rows.values())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string")
    for parts in (1, 7):
        assert substring_dedup.hot_buckets(df.repartition(parts), run).tolist() == want
    assert substring_dedup.hot_buckets(df.limit(0), run).tolist() == []
