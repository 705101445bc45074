"""Pigeonhole matching against a plain edit-distance table over every text."""

import random

from tallyhouse.llm import decontamination
from tallyhouse.llm.decontamination import best_end, contaminations, decontaminated, words


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    random.seed(1)
    for _ in range(3000):
        p, t = random.choices("abc", k=random.randint(1, 9)), random.choices("abc", k=random.randint(0, 14))
        assert best_end(p, t)[0] == distance(p, t)


def edited(ws, n):
    ws = list(ws)
    for _ in range(n):
        i = random.randrange(len(ws))
        kind = random.random()
        if kind < 0.4:
            ws[i] = "zz"
        elif kind < 0.7:
            del ws[i]
        else:
            ws.insert(i, "yy")
    return ws


def test_against_brute_force(spark, monkeypatch):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(3, 45)))) for i in range(25)] + [(90, None), (91, "")]
    items.append((92, items[3][1]))
    docs = []
    for i in range(120):
        ws = random.choices(vocabulary, k=random.randint(0, 60))
        at = random.randint(0, len(ws))
        ws[at:at] = edited(words(random.choice(items[:25])[1]), random.randint(0, 6))
        docs.append((i % 100, " ".join(ws).capitalize().replace(" w1 ", ",\n w1! "), i))
    docs += [(500, None, 0), (None, "", 0), (501, "w1 " * 3000, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, distance int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(k), i, distance(words(x), words(t))) for k, t, _ in docs for i, x in items if words(x) and distance(words(x), words(t)) <= int(0.1 * len(words(x))))
    got = contaminations(d, b).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got) == want and len(want) > 20
    for r in got:
        own = [words(t)[r.first_word:r.end_word] for k, t, _ in docs if k == r.doc_id]
        assert r.distance in [distance(words(dict(items)[r.item_id]), x) for x in own]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    assert sorted(map(str, contaminations(d, b).collect())) == sorted(map(str, got))
    bad = {(k, t) for k, t, _ in docs if any(len(words(x)) >= 8 and distance(words(x), words(t)) <= int(0.1 * len(words(x))) for _, x in items)}
    assert sorted(map(str, decontaminated(d, b).collect())) == sorted(map(str, (r for r in d.collect() if (r.doc_id, r.text) not in bad)))


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contaminations(d, b).collect() == [] and decontaminated(d, b).count() == 1
    assert contaminations(d.limit(0), b).collect() == []


def test_short_items_are_reported_but_take_nothing_away(spark):
    docs = spark.createDataFrame([(1, "so the answer is forty two, he said"), (2, "nothing here"), (3, None), (4, "Forty-two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "forty two"), (2, ""), (3, None), (4, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.first_word, r.end_word, r.item_words) for r in contaminations(docs, items).collect()}
    assert got == {(1, 1, 0, 4, 6, 2), (4, 1, 0, 0, 2, 2)}
    assert decontaminated(docs, items).count() == 4
    assert contaminations(docs, items.limit(0)).collect() == [] and contaminations(docs.limit(0), items).collect() == []
