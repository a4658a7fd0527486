"""What sums over partitions take from the driver."""

import tracemalloc
import zlib

import numpy as np

from lexmill.llm import decontaminate, jaccard, store


def collected(monkeypatch):
    """Rows of every ``collect`` from now on."""
    import pyspark.sql.classic.dataframe as classic

    seen, collect = [], classic.DataFrame.collect

    def noted(self):
        rows = collect(self)
        seen.extend(rows)
        return rows

    monkeypatch.setattr(classic.DataFrame, "collect", noted)
    return seen


def test_large_sums_come_in_pieces(spark, monkeypatch):
    shape = (3, 100_003)
    step = np.arange(np.prod(shape), dtype=np.float64).reshape(shape)

    def fold(batches):
        return step * sum(int(np.asarray(b.column(0)).sum()) for b in batches)

    rows = collected(monkeypatch)
    total = store.partition_sums(spark.range(40).repartition(20), fold, shape)
    assert np.array_equal(total, step * 780) and total.flags.writeable
    assert max(len(r.payload) for r in rows if "payload" in r) <= 1 << 18


def test_several_payloads_stay_apart_and_in_order(spark):
    data = spark.range(0, 12, 1, 3)

    def first(batches):
        ids = [x for b in batches for x in b.column(0).to_pylist()]
        return bytes([ids[0]]) * 400_000 if ids and ids[0] != 4 else b""

    assert [(len(x), set(x)) for x in store.gather(data, first, lambda x: b"".join(x))] in ([(400_000, {0}), (0, set()), (400_000, {8})], [(400_000, {0}), (400_000, {8})])
    assert store.gather(data.where("id < 0"), lambda batches: None, lambda x: b"") == []
    assert np.array_equal(store.partition_sums(data.where("id < 0"), lambda batches: None, (2, 2)), np.zeros((2, 2)))


def test_rarity_is_made_in_parts(spark):
    counts = np.zeros(jaccard.SKETCH, np.uint8)
    counts[:1000] = np.arange(1000) % 256
    frame = spark.createDataFrame([(zlib.compress(counts.tobytes(), 1),)] * 2, "counts binary")
    jaccard._rarity(frame)  # what is loaded once is not counted
    tracemalloc.start()
    found = jaccard._rarity(frame)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, np.floor(2 * np.log2(2.0 * counts + 1.0)).astype(np.uint8))
    assert most < 8 * jaccard.SKETCH  # the table takes 4 bytes a counter, the result 1


def test_axes_are_shared_once_and_released(spark, monkeypatch):
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    rows = [(terms[rng.integers(0, 300, 40)].tobytes(),) for _ in range(30)]
    passages = spark.createDataFrame(rows, "words binary")
    space = decontaminate.Space(np.ones(decontaminate.TABLE), terms, np.arange(300), np.zeros((300, 0)))
    made, broadcast = [], type(spark.sparkContext).broadcast

    def noted(self, value):
        made.append(broadcast(self, value))
        return made[-1]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", noted)
    axes = decontaminate.randomised_svd(passages, space, 300, 30)
    a = np.zeros((30, 300))
    for i, (raw,) in enumerate(rows):
        row, value, length = space.vector(np.frombuffer(raw, np.uint64))
        a[i, row] = value / length
    assert np.allclose(a @ axes @ axes.T, a, atol=1e-8)
    shared = [x for x in made if isinstance(getattr(x, "_value", None), tuple) or not x._jbroadcast.isValid()]
    assert len(shared) == 3 and not any(x._jbroadcast.isValid() for x in shared)
