"""What iterative operators share: cutting lineage, and greedy choices in a given order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared(spark)}/lexmill/{label}-{uuid.uuid4().hex}"


#: While a step is written: its shuffle files go when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to Parquet files in the shared folder and read back: later steps start from there."""
    spark = df.sparkSession
    path, before = scratch(spark, "step"), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the files of settled steps that nothing reads any more."""
    for df in steps:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table that may be broadcast after its rows were counted.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unmarked (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Bytes of text that a task works on when texts are dealt whole; their terms with counts take several times as much.
DEALT = 8 << 20


def dealt(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` dealt by key, to as many tasks as their texts need: a task's texts have a bound, however large the table is.

    By size of what is shuffled Spark would put together texts whose terms, held by several steps of one task, are too many.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT)), key)


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Each node's leader, as a walk over the nodes in order would find it: id and leader.

    In the walk a node follows the first leader before it that it is linked with, or becomes a leader.
    ``nodes``: id and ord, a total order; ``links``: pairs (a, b) in either direction or both. Instead of
    walking, rounds settle all nodes whose fate is known: a node all of whose earlier neighbours are
    followers leads, and a node with an earlier leader follows. As many rounds as the longest chain of
    nodes that wait for each other; each is one join of the links that are left, and no group meets in one task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    order = nodes.select("id", "ord")
    # later <- earlier, with the places of both
    back = both.join(order.select(F.col("id").alias("a"), F.col("ord").alias("at")), "a").join(order.select(F.col("id").alias("b"), F.col("ord").alias("from")), "b")
    back = settled(back.where("from < at").select(F.col("a").alias("id"), F.col("b").alias("early"), "from"))
    new = settled(nodes.select("id").join(back.select("id").distinct(), "id", "left_anti"))
    leading, waiting = new, back
    while True:
        followers = settled(waiting.join(new.select(F.col("id").alias("early")), "early", "left_semi").select("id").distinct())
        if followers.isEmpty():  # then nobody waits: the first one that did would have been settled
            break
        left = waiting.join(followers, "id", "left_anti")
        waiting = settled(left.join(followers.select(F.col("id").alias("early")), "early", "left_anti"))
        new = settled(left.select("id").distinct().join(waiting.select("id").distinct(), "id", "left_anti"))
        leading = leading.unionByName(new)
    first = back.join(leading.select(F.col("id").alias("early")), "early", "left_semi").groupBy("id").agg(F.min_by("early", "from").alias("leader"))
    led = first.join(leading, "id", "left_anti")
    return leading.select("id", F.col("id").alias("leader")).unionByName(led)
