"""Profiles of texts that arrive in batches are those of the whole texts."""

import random

from pyspark.sql import functions as F

from lexmill.streaming import profiles

SCHEMA = "doc_id long, sent_id long, words array<string>, n_words long, is_last boolean"


def test_stream_in_three_starts_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for doc in range(12):
        size = rng.randrange(1, 40)
        for i in range(size):
            words = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
            rows.append((doc, i * 2, words, len(words), i == size - 1))
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    every = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):  # a file each; the second start finds two texts' sentences again
        new = every.where((F.col("sent_id") >= part * 20) & ((F.col("sent_id") < part * 20 + 20) | F.lit(part == 2)))
        again = every.where((F.col("doc_id") < 2) & (F.col("sent_id") < 20)) if part == 1 else every.limit(0)
        new.unionByName(again).coalesce(1).write.mode("append").parquet(source)
        profiles.run_to_table(spark, source, sink, check, ["a", "b"], 7)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == sorted(map(tuple, profiles.binned(every, ["a", "b"], 7).collect())) and got


def test_texts_of_a_bucket_share_a_group(spark, tmp_path):
    rows = [(doc, i, ["a", "b", "c"][: 1 + ((doc or 0) + i) % 3], 1 + ((doc or 0) + i) % 3, i == 19) for doc in [*range(50), 2**60 + 1, None] for i in range(20)]
    every = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((r.doc_id, r.bin, r.term, r.n) for r in profiles.binned(every.fillna(-1, ["doc_id"]), ["a", "b"], 7).collect()))
    for buckets in (None, 4):
        source, sink, check = (str(tmp_path / f"{x}{buckets}") for x in ("in", "out", "check"))
        for part in range(2):
            every.where(F.floor(F.col("sent_id") / 10) == part).coalesce(1).write.mode("append").parquet(source)
            profiles.run_to_table(spark, source, sink, check, ["a", "b"], 7, buckets=buckets)
        found = spark.read.parquet(sink)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.bin, r.term, r.n) for r in found.collect()) == want and found.schema["doc_id"].dataType.simpleString() == "bigint"
