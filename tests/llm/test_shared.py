"""Words of a batch of texts against ``bytes.split``, and that they are not all Python objects at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import shared
from tallyhouse.llm.decontamination import contaminations, decontaminated
from tallyhouse.llm.jaccard_join import jaccard_groups
from tallyhouse.llm.kneser_ney import score, train
from tallyhouse.llm.pii import mask_pii, pii_spans
from tallyhouse.llm.shared import ARROW_BYTES, BATCH_BYTES, lowered, plain, token_chunks


@pytest.mark.parametrize(("split", "by_text"), [(plain, lambda t: t.encode().split()), (lowered, lambda t: t.encode().lower().split())])
@pytest.mark.parametrize("slice_bytes", [1, 40, 1 << 20])
def test_words(split, by_text, slice_bytes, monkeypatch):
    monkeypatch.setattr(shared, "SLICE_BYTES", slice_bytes)
    random.seed(5)
    for kind in (pa.string(), pa.large_string()):
        texts = [None if random.random() < 0.1 else "".join(random.choices("aAbB \t\n\x0b\x0c\r\x1c\x1f\x85\xa0éÉ\U0001f600", k=random.choice([0, 1, 2, 9, 30]))) for _ in range(120)]
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(range(len(x)), pa.int64()), "text": pa.array(x, kind)}) for x in (texts[:70], [], texts[70:])]
        for most in (1, 17, 10_000):
            got, rows, sizes = [], [], []
            for part, codes, words, lengths in token_chunks(batches, split, 1, most):
                every = [words[c] for c in codes.tolist()]
                ends = np.cumsum(lengths - 1).tolist()
                got += [every[s:e] for s, e in zip([0, *ends], ends)]
                rows += part.column("text").to_pylist()
                sizes.append((len(codes), len(got[-1])))
                assert len(set(words)) == len(words) == len(set(codes.tolist()))
            assert rows == texts and got == [by_text(t or "") for t in texts]
            assert all(n >= most > n - last for n, last in sizes[:-1])


def test_memory():
    """400,000 words, 1,000 different ones, cost no more Python memory than their codes and a little."""
    random.seed(6)
    texts = pa.array([" ".join(f"word{random.randrange(1_000)}" for _ in range(500)) for _ in range(800)])
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    n = sum(len(codes) for _, codes, _, _ in token_chunks([batch], lowered, most=400_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 8 << 20


def largest_batch(spark):
    """Bytes of the largest Arrow batch of 2,000 texts of 4,000 characters in one partition."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    return max(r.n for r in spark.range(0, 2_000, 1, 1).selectExpr("repeat('text', 1000) as text").mapInArrow(run, "n long").collect())


def test_small_batches(spark):
    """The operators that send texts to Python cut Arrow batches short, and leave a limit that the session was given."""
    docs = spark.createDataFrame([(i, f"a text of no {i} or so") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "an item of five words")], "item_id long, text string")
    before = spark.conf.get(ARROW_BYTES, None)
    try:
        for operator in (lambda: train(docs, 2, 2), lambda: score(docs, {}), lambda: jaccard_groups(docs), lambda: contaminations(docs, items), lambda: decontaminated(docs, items), lambda: mask_pii(docs), lambda: pii_spans(docs)):
            spark.conf.unset(ARROW_BYTES)
            operator()
            assert largest_batch(spark) < 1.1 * BATCH_BYTES
        spark.conf.set(ARROW_BYTES, "3m")
        mask_pii(docs)
        assert BATCH_BYTES < largest_batch(spark) < 3.3 * (1 << 20)
    finally:
        spark.conf.set(ARROW_BYTES, before) if before else spark.conf.unset(ARROW_BYTES)
