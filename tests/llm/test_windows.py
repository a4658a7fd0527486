"""Windows of decontamination are folded together before any is compared exactly."""

import numpy as np
import pyarrow as pa

from lexmill.llm import decontaminate as dc


def some_space(rng, passages=12, words=300):
    """Passages of random words, with as many axes as passages."""
    vocabulary = rng.integers(1, 2**63, words).astype(np.uint64)
    own = [rng.choice(vocabulary[:150], rng.integers(8, 64)) for _ in range(passages)]
    terms = np.unique(np.concatenate(own))
    idf = rng.uniform(0.5, 8.0, dc.TABLE)
    axes = np.linalg.qr(rng.normal(size=(len(terms), passages)))[0]
    space = dc.Space(idf, terms, np.arange(len(terms)), axes)
    rows = [type("R", (), {"item_id": i, "times": 1, "words": w.tobytes(), "answer": b""}) for i, w in enumerate(own)]
    return vocabulary, space, dc._known(rows, space, False), rows


def test_windows_that_reach_the_limit_stay(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary, space, known, rows = some_space(rng)
    texts = [rng.choice(vocabulary, n) for n in (0, 5, 40, 700)] + [np.full(50, vocabulary[0]), known.words[0], rng.integers(1, 2**63, 30).astype(np.uint64)]
    off = np.cumsum([0] + [len(t) for t in texts])
    hashes = np.concatenate(texts)
    windows = [(i, a, min(a + span, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), 16) for span in (32, 64)]
    text, start, end = (np.array(x) for x in zip(*windows))
    best = np.array([known.cosines(space, hashes[off[i] + a : off[i] + z]).max() for i, a, z in windows])
    for folded in (dc.FOLDED, 100):
        monkeypatch.setattr(dc, "FOLDED", folded)
        for limit in (-0.5, 0.0, 0.1, 0.3, float(np.median(best)), 0.99):
            kept = dc.likely(hashes, off, text, start, end, space, known, limit)
            assert kept[best >= limit].all() and not kept[best < limit - 2 * dc.SINGLE].any()
    assert not len(dc.likely(hashes, off, text[:0], start[:0], end[:0], space, known, 0.3))
    assert dc.likely(hashes, off, text, start, end, space, dc._known(rows, space, True), 0.99).all()


def test_few_windows_are_compared_exactly(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(9)
    items = [" ".join(rng.choice(words, 20)) for _ in range(6)]
    docs = [" ".join(rng.choice(words, 200)) for _ in range(30)] + [items[2] + " " + " ".join(rng.choice(words, 40))]
    held = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=type(spark.sparkContext).broadcast: (held.append(value), f(self, value))[1])
    found = dc.search(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(30, 2)}
    space, passages, bounds = held[-1]
    hashes, off = dc.stripped(pa.array(docs))
    text, start, end = dc.screen(hashes, off, space, bounds, len(passages.words), 0.3)
    near = dc.likely(hashes, off, text, start, end, space, passages, 0.3)
    exact = [passages.cosines(space, hashes[off[i] + a : off[i] + z]).max() >= 0.3 for i, a, z in zip(text, start, end)]
    assert near[exact].all() and near.sum() <= sum(exact) + 1
