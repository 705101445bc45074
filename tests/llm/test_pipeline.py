"""Each stage of the pipeline on planted cases, and the whole run."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(8)
    vocabulary = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(random.choices(vocabulary, k=random.randint(40, 90))), "en", f"s{i % 4}") for i in range(400)]
    item = " ".join(random.choices(vocabulary, k=30))
    rows += [(1000 + i, rows[i][1] if i % 2 else rows[i][1] + " tail", "en", "s1") for i in range(10)]
    rows += [(2000, rows[50][1] + " " + item + " " + rows[51][1], "en", "s2"), (2001, rows[52][1] + " Mail a.b@c.de " + rows[53][1], "en", "s2")]
    rows += [(3000 + i, " ".join("".join(random.choices("xqzkj", k=5)) for _ in range(60)), "en", "s3") for i in range(10)]
    rows += [(4000, None, None, None), (4001, "", "en", None)]
    labels = [(i, 1, 0) for i in range(390)] + [(3000 + i, 0, 0) for i in range(10)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, tables)
        if i < 4:
            assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, "test")
        seen.append((before, {r.doc_id: r for r in docs.collect()}))
    (a, b), (_, c), (_, d), (_, e), (f, g) = seen
    assert not any(3000 <= k < 3010 for k in b) and sum(k < 1000 for k in b) > 390 and b.keys() <= a.keys()
    assert b.keys() - c.keys() == {k for k in b if 1000 <= k < 1010}
    assert c.keys() - d.keys() == {2000}
    assert e.keys() == d.keys() and "<EMAIL>" in e[2001].text and "a.b@c.de" not in e[2001].text and all(r.n_chars == len(r.text) for r in e.values() if r.text is not None)
    assert all(r.text == d[k].text for k, r in e.items() if k != 2001)
    sizes = {k: len((r.text or "").split()) for k, r in f.items()}
    for s in {r.source for r in g.values()}:
        own = [r for r in g.values() if r.source == s]
        assert own[0].source_size == sum(sizes[k] for k, r in f.items() if r.source == s)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    assert all(0 < r.taken <= 3 * r.size and r.size == sizes[k] for k, r in g.items())
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, tables).collect()} == {k: r.taken for k, r in g.items()}


def small(spark, at, rows, more=""):
    """The three tables of a run at ``at``; rows: doc_id, text, lang, source."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + more
    extra = tuple(range(len(more.split(",")) - 1))
    spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, small(spark, tmp_path, [])).collect() == []


def test_repeated_and_null_keys(spark, tmp_path):
    """Of rows of one key with different texts each stays; of equal texts one does."""
    random.seed(3)
    texts = [" ".join(random.choices([f"w{i}" for i in range(300)], k=40)) for _ in range(6)]
    rows = [(1, texts[0], "en", "s"), (1, texts[1], "en", "s"), (1, texts[0], "en", "s"), (2, texts[2], "en", "s"), (None, texts[3], "en", "s"), (None, texts[4], None, None), (None, texts[3], "en", "s"), (3, None, None, None), (3, texts[2], "en", "s")]
    got = corpus_pipeline.run(spark, small(spark, tmp_path, rows)).collect()
    assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows} and all(r.taken > 0 for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([("1", texts[0]), ("1", texts[1]), ("2", texts[2]), ("None", texts[3]), ("None", texts[4]), ("3", "None")])


def test_clashing_columns(spark, tmp_path):
    """Columns of names that the stages use inside travel through all but the last as they are."""
    names = ["id", "key", "set", "grams", "row", "own", "mix", "kept", "score", "pii_spans", "component", "cid", "bucket", "block", "at", "hits"]
    random.seed(4)
    rows = [(i, " ".join(random.choices([f"w{k}" for k in range(300)], k=40)), "en", f"s{i % 2}") for i in range(60)]
    at = small(spark, tmp_path, rows, "".join(f", {n} int" for n in names))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    out = docs.collect()
    assert len(out) >= 55 and all(tuple(r)[5:] == tuple(range(len(names))) for r in out)
    assert all(r.taken > 0 and r.key == 1 for r in corpus_pipeline.run(spark, at).collect())
