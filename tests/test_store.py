"""The store of records by key, listings and merging of topics."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.sources import store

SCHEMA = "number long, status string, title string, tags array<string>"


def rows(spark, *found):
    return spark.createDataFrame([(n, s, t, ["x"]) for n, s, t in found], SCHEMA)


def test_nothing_stored(spark, tmp_path):
    assert store.read(spark, str(tmp_path)) is None and store.load_article(spark, str(tmp_path), 1) is None


def test_save_lookup_and_markers(spark, tmp_path):
    path = str(tmp_path / "s")
    many = spark.range(500).select(F.col("id").alias("number"), F.lit("ok").alias("status"), F.concat(F.lit("t"), "id").alias("title"), F.array(F.lit("x")).alias("tags"))
    assert store.save(many, path, "number", buckets=16) == 0
    assert store.save(rows(spark, (3, "ok", "again"), (700, "bad", "marker"), (700, "ok", "usable"), (None, "ok", "no key")), path, "number") == 1
    assert store.read(spark, path).count() == 501
    assert store.load_article(spark, path, 3).first().title == "t3" and store.load_article(spark, path, 700).first().title == "marker"
    assert store.load_article(spark, path, 12345).count() == 0
    found = store.lookup(spark, path, 42)
    assert [r.title for r in found.collect()] == ["t42"]
    # the files of one bucket, of sixteen, are read
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == {str(spark.range(1).select(store.bucket_of(F.lit(42).cast("long"), 16)).first()[0])}
    assert store.save(rows(spark, (3, "ok", "new")), path, "number", overwrite=True) == 2
    assert store.load_article(spark, path, 3).first().title == "new" and store.read(spark, path).count() == 501


def test_a_save_repeated_after_a_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.save(rows(spark, (1, "ok", "a")), path, "number", buckets=4)
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save(rows(spark, (2, "ok", "b"), (3, "ok", "c")), path, "number")
    assert store.read(spark, path).count() == 1  # its files are there, but no manifest names them
    monkeypatch.setattr(store, "_publish", publish)
    for _ in range(2):
        store.save(rows(spark, (2, "ok", "b"), (3, "ok", "c")), path, "number")
    assert sorted(r.number for r in store.read(spark, path).collect()) == [1, 2, 3]


def test_another_save_was_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.save(rows(spark, (1, "ok", "a")), path, "number", buckets=4)
    publish, calls = store._publish, []

    def late(spark_, where, content):
        if not calls:
            calls.append(1)
            store.save(rows(spark, (2, "ok", "other")), path, "number")
        return publish(spark_, where, content)

    monkeypatch.setattr(store, "_publish", late)
    assert store.save(rows(spark, (2, "ok", "mine"), (3, "ok", "c")), path, "number") == 2
    assert sorted((r.number, r.title) for r in store.read(spark, path).collect()) == [(1, "a"), (2, "other"), (3, "c")]


def test_topics_are_merged_and_listed(spark, tmp_path):
    path = str(tmp_path / "topics")
    kind = "number long, topic string, url string, title string"
    store.merge_topics(spark, spark.createDataFrame([(2, "t", "/a/n/two", "two"), (9, "u", "/a/n/nine", "nine")], kind), path)
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "topic=u" in f}
    store.merge_topics(spark, spark.createDataFrame([(1, "t", "/a/n/one", "o\tne"), (2, "t", "/a/n/two", "two")], kind), path)
    found = spark.read.parquet(path)
    assert sorted((r.topic, r.number) for r in found.collect()) == [("t", 1), ("t", 2), ("t", 2), ("u", 9)]
    assert untouched == {f for f in found.inputFiles() if "topic=u" in f}
    lines = store.topic_listing(found, tx.hex_id(F.element_at(F.split("url", "/"), -1))).where("topic = 't'").orderBy("number").collect()
    assert [line.line.split("\t")[0] for line in lines] == ["1", "2", "2"] and lines[0].line.endswith(".pkl\to ne")
