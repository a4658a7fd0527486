"""A store of records by key: files by bucket of the key, a manifest that names them, and commits that may be repeated.

A store is a folder. ``data/<version>-<n>/bucket=<b>/`` holds Parquet files of the records whose key hashes to
bucket b; ``manifest/<version>.json`` lists for each bucket the folders to read. A save writes its files first and then
its manifest, by a rename that fails if the version is taken, so readers see a save whole or not at all, and what
a failed save left is never read. Markers of unusable records are stored beside records under the same key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: version, key, buckets, and the folders of each bucket; None if nothing was saved."""
    fs, folder = _fs(spark, path), _path(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())
    if not versions:
        return None
    stream = fs.open(_path(spark, f"{path}/manifest/{versions[-1]:012d}.json"))
    try:
        return json.loads(str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Whether ``content`` became the manifest of its version; another save may have been first."""
    fs = _fs(spark, path)
    staged = _path(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target = _path(spark, f"{path}/manifest/{content['version']:012d}.json")
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        return False
    return True


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All records; None if nothing was saved."""
    found = manifest(spark, path)
    return None if found is None else _folders(spark, path, found, range(found["buckets"]))


def _folders(spark: SparkSession, path: str, found: dict, buckets) -> DataFrame:
    wanted = [f"{path}/data/{folder}/bucket={b}" for b in buckets for folder in found["folders"].get(str(b), [])]
    schema = spark.createDataFrame([], found["schema"]).schema
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def lookup(spark: SparkSession, path: str, *keys) -> DataFrame | None:
    """The records of some keys: only the files of their buckets are opened."""
    found = manifest(spark, path)
    if found is None:
        return None
    kind = dict(spark.createDataFrame([], found["schema"]).dtypes)[found["key"]]
    asked = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    buckets = sorted({r.b for r in asked.select(bucket_of(F.col("k"), found["buckets"]).alias("b")).collect()})  # as many as keys were asked for
    return _folders(spark, path, found, buckets).where(F.col(found["key"]).isin(*keys))


def load_article(spark: SparkSession, path: str, key) -> DataFrame | None:
    """The record of a key; a marker (status other than ok) wins over a usable record."""
    found = lookup(spark, path, key)
    return None if found is None else found.orderBy((F.col("status") == "ok").cast("int")).limit(1)


def save(rows: DataFrame, path: str, key: str, overwrite: bool = False, buckets: int = BUCKETS, attempts: int = 5) -> int:
    """Save the rows whose key is not stored yet (all with ``overwrite``: they replace what is stored); the version.

    Of rows that repeat a key one is saved, a marker before a usable one. A save repeated after a failure adds nothing
    twice: keys are looked up in the manifest, and files without one do not count. If another save
    publishes first, this one starts again from what that one left.
    """
    spark = rows.sparkSession
    rank = F.struct((F.col("status") == "ok").cast("int"), F.xxhash64(*[F.col(c) for c in rows.columns if not dict(rows.dtypes)[c].startswith("map")])) if "status" in rows.columns else F.xxhash64(key)
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), rank).alias("r")).select("r.*")
    for _ in range(attempts):
        before = manifest(spark, path)
        n = before["buckets"] if before else buckets
        folder = f"{before['version'] + 1 if before else 0:012d}-{uuid.uuid4().hex[:8]}"
        new = once
        if before:
            stored = _folders(spark, path, before, range(n))
            new = once.unionByName(stored.join(once.select(key), key, "left_anti")) if overwrite else once.join(stored.select(key), key, "left_anti")
        new.withColumn("bucket", bucket_of(F.col(key), n)).repartition(n, "bucket").sortWithinPartitions(key).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        written = [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, f"{path}/data/{folder}"))]
        folders = {} if overwrite or not before else {b: list(f) for b, f in before["folders"].items()}
        for name in written:
            if name.startswith("bucket="):
                folders.setdefault(name.removeprefix("bucket="), []).append(folder)
        content = {"version": before["version"] + 1 if before else 0, "key": key, "buckets": n, "folders": folders, "schema": before["schema"] if before else rows.schema.simpleString()}
        if _publish(spark, path, content):
            return content["version"]
    raise RuntimeError(f"{path}: other saves were first {attempts} times")


def topic_listing(previews: DataFrame, hex_id: Column) -> DataFrame:
    """The listing of a topic: a line a preview, number, file name and title parted by tabs; topic, number and line."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\t\r\n]+", " ")
    return previews.select("topic", "number", F.concat_ws("\t", F.col("number").cast("string"), F.concat(hex_id, F.lit(".pkl")), clean).alias("line"))


def merge_topics(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Add previews to what a folder by topic holds, in number order, only rewriting the topics that get new ones.

    Old and new previews both stay, as they are. The rewritten topics are staged beside the folder and replace it one
    partition at a time.
    """
    try:
        old = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    touched = old.select(*new.columns).join(new.select("topic").distinct(), "topic", "left_semi")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex[:8]}"
    touched.unionByName(new).repartition("topic").sortWithinPartitions("topic", "number").write.partitionBy("topic").parquet(staged)
    ready = spark.read.parquet(staged)
    ready.repartition("topic").sortWithinPartitions("topic", "number").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic").parquet(path)
    _fs(spark, staged).delete(_path(spark, staged), True)
