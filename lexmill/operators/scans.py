"""Scans over keys of any length: running values inside ranges of the order, and borders stitched from one row a range.

A window over a whole key puts it into one task. Here rows are dealt by ranges of (keys, order), windows
run inside (keys, range), and one row for each of a key's ranges carries what the ranges before it add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.rounds import settled

RANGE = "_range"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` from a checkpoint, with the number of their range; rows equal in keys and order share a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def same_key(keys: list[str], a: str = "a", b: str = "b") -> Column:
    """Both sides have the same keys (nulls alike) and the same range."""
    test = F.col(f"{a}.{RANGE}") == F.col(f"{b}.{RANGE}")
    for k in keys:
        test = test & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return test


def running(rows: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """``rows`` with running sums: each name is the sum of a column up to and with the row, in the order of its key.

    ``order`` must tell the rows of a key apart.
    """
    dealt = ranged(rows, keys, order)
    inside = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per_range = dealt.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(*keys, RANGE, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = dealt.select(*dealt.columns, *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.alias("a").join(offsets.alias("b"), same_key(keys))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])


def gaps(numbers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo and hi of the numbers missing between two present ones (column ``number``, each once a key)."""
    dealt = ranged(numbers.select(*keys, "number"), keys, ["number"])
    before = F.lag("number").over(W.partitionBy(*keys, RANGE).orderBy("number"))
    inner = dealt.select(*keys, (before + 1).alias("lo"), (F.col("number") - 1).alias("hi"))
    ends = dealt.groupBy(*keys, RANGE).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    border = ends.select(*keys, (F.lag("last").over(W.partitionBy(*keys).orderBy(RANGE)) + 1).alias("lo"), (F.col("first") - 1).alias("hi"))
    return inner.unionByName(border).where("lo <= hi")


def islands(rows: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """keys, lo and hi of the runs of consecutive numbers whose rows are all ``wanted`` (a boolean column).

    Rows that repeat a number begin a new run.
    """
    dealt = ranged(rows.select(*keys, "number", F.col(wanted).alias("_on")), keys, ["number"])
    at = W.partitionBy(*keys, RANGE).orderBy("number")
    goes_on = (F.lag("number").over(at) == F.col("number") - 1) & F.lag("_on").over(at)
    runs = dealt.select(*keys, RANGE, "number", "_on", F.when(goes_on, 0).otherwise(1).alias("_new"), F.row_number().over(at).alias("_i"), F.lead("number").over(at).isNull().alias("_end"))
    runs = runs.withColumn("_run", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0))).where("_on")
    local = runs.groupBy(*keys, RANGE, "_run").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), (F.min("_i") == 1).alias("_head"), F.bool_or("_end").alias("_tail"))
    # at most two runs of a range touch its borders
    order = W.partitionBy(*keys).orderBy(RANGE, "lo")
    joins = F.col("_head") & F.lag("_tail").over(order) & (F.lag("hi").over(order) == F.col("lo") - 1)
    border = local.where("_head or _tail").withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    stitched = border.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return local.where("not (_head or _tail)").select(*keys, "lo", "hi").unionByName(stitched.select(*keys, "lo", "hi"))


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges lo..hi (hi null: open) as the fewest ranges that hold the same numbers, none touching another."""
    last = 2**63 - 1
    closed = ranges.select("lo", F.coalesce("hi", F.lit(last)).alias("hi")).where("lo <= hi").groupBy("lo").agg(F.max("hi").alias("hi"))
    dealt = ranged(closed, [], ["lo"])
    inside = W.partitionBy(RANGE).orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    reach = dealt.groupBy(RANGE).agg(F.max("hi").alias("reach"))
    before = reach.select(RANGE, F.max("reach").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)).alias("before"))  # one row a range
    seen = dealt.withColumn("_in", F.max("hi").over(inside)).join(before, RANGE).withColumn("_seen", F.greatest("_in", "before"))
    # the end of a merged range is what was seen before the next one begins: the start after it tells
    marked = seen.select("lo", "hi", F.when(F.col("_seen").isNull() | (F.col("lo") - 1 > F.col("_seen")), 1).otherwise(0).alias("new"))
    numbered = running(marked, [], ["lo"], run="new")
    found = numbered.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.select("lo", F.when(F.col("hi") < last, F.col("hi")).alias("hi"))
