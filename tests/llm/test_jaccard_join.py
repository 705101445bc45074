"""Groups and links against all pairs compared plainly."""

import random

import pytest

from tallyhouse.llm import jaccard_join
from tallyhouse.llm.graph import components
from tallyhouse.llm.jaccard_join import jaccard_groups, least_matches, one_of_each_group


def gram_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [gram_set(t) for _, t in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in linked[todo.pop()] if j not in seen and not seen.add(j)]
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys, default=None), len({frozenset(sets[j]) for j in linked[i]} - {frozenset(sets[i])}), len(linked[i])))
    return out


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(30, 120))) for _ in range(60)]
    for base in range(12):
        for _ in range(random.randint(1, 8)):
            w = texts[base].split()
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = "new%d" % random.randrange(99)
            texts.append(" ".join(w))
    hot = random.choices(vocabulary, k=100)
    for _ in range(90):
        w = list(hot)
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = "hot%d" % random.randrange(9)
        texts.append(" ".join(w))
    texts += ["", None, "a b", "a  b", "A B", "c", " ", texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    return rows + [(None, texts[4]), (None, "only here without a key"), (None, "only here without a key"), (5, texts[5])]


@pytest.mark.parametrize("small, block", [(32, 256), (3, 8), (10_000, 256)])
def test_against_brute_force(spark, small, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_links int").repartition(3)
    got = sorted(str((r.doc_id, r.group_id, r.n_linked_texts, r.n_links)) for r in jaccard_groups(df).collect())
    assert got == sorted(map(str, brute(rows)))


def test_one_of_each(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(str(r.doc_id) for r in one_of_each_group(df).collect())
    want = sorted([str(k) for k, g, *_ in set(brute(rows)) if k is not None and k == g] + ["None"])  # null keys are one group of two copies, and a copy of a text with a key
    assert kept == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups(df).collect() == [] and one_of_each_group(df).collect() == []


def test_components(spark):
    random.seed(4)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 301), (301, 300), (302, 302)]
    random.shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}


def test_posterior():
    assert [least_matches(n, 0.8, 1e-7) for n in (20, 40, 200)] == sorted(least_matches(n, 0.8, 1e-7) for n in (20, 40, 200))
    assert least_matches(200, 0.8, 1e-7) < 160


def test_one_of_each_group_by_row(spark):
    """Repeated and null keys with different texts lose none of them; copies leave one row."""
    import random

    from tallyhouse.llm.jaccard_join import one_of_each_group

    random.seed(12)
    a, b, c, d, e = (" ".join(f"{x}{random.randrange(10 ** 6)}" for _ in range(60)) for x in "abcde")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d.upper()), (None, e), (None, e), (None, a), (8, None), (8, ""), (None, None), (9, e + " more")]
    df = spark.createDataFrame([(*r, i, "x", 0) for i, r in enumerate(rows)], "doc_id long, text string, set int, row string, component int").repartition(3)
    got = one_of_each_group(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text.lower() if r.text else r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (7, c), (7, d), (9, e + " more"), (8, None), (8, ""), (None, None)], key=str)
    assert one_of_each_group(df.limit(0)).collect() == []


def test_components_with_heavy_nodes(spark, monkeypatch):
    import random

    from tallyhouse.llm import graph

    monkeypatch.setattr(graph, "HEAVY", 3)
    random.seed(13)
    edges = [(0, i) for i in range(1, 40)] + [(100 + random.randrange(60), 100 + random.randrange(60)) for _ in range(50)] + [(200, i) for i in range(201, 230)] + [(i, i + 1) for i in range(300, 330)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_small_parts(spark, monkeypatch):
    """A task copies a batch of 400,000 words, or of 4,000 pairs of sets, in small parts."""
    import tracemalloc

    import pyarrow as pa

    random.seed(15)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(800), pa.int64()), "text": [" ".join(f"word{random.randrange(1_000)}" for _ in range(500)) for _ in range(800)]})
    run = jaccard_join.signatures(df, "doc_id")
    signs = pa.Table.from_batches(list(run([batch])))
    wide = pa.table({"cid": pa.array(range(4_000), pa.int64()), "signature": signs.column("signature").combine_chunks().take(pa.array([i % 800 for i in range(4_000)]))}).combine_chunks().to_batches()
    bands = jaccard_join.bands(df.selectExpr("doc_id as cid", "binary(text) as signature"))
    for work, batches, most in ((run, [batch], 12 << 20), (bands, wide, 6 << 20)):
        tracemalloc.start()
        n = sum(b.num_rows for b in work(batches))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n in (800, 4_000 * jaccard_join.BANDS) and peak < most
