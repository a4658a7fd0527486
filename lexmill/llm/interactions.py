"""Audit of filter orders: what each filter removes at each step of every order of the filters.

Each text gets a mask, one bit a filter that it fails; rows are counted by part and mask (two to the
number of filters cells a part, whatever the rows), cells are unpivoted against the steps of all
orders, a running bit-or over an order's earlier steps tells which cells are gone before a step,
conditional sums give the figures, and a window over (part, filter) adds up what a filter removes in
all orders.

Whether an equal text has a smaller id is found without bringing equal texts together: rows are
counted by (digest, id), the smallest id of each class of texts and cell comes from partial sums,
and only cells of a class meet. Digests are 128 bits of SHA-256.

Defined cases: a null text is empty and equal to an empty one; a null ``lang`` is the part ``''``; a
row without an id comes after all others, so it fails ``E`` only if an equal text has an id, and it
has no labels; rows that repeat the smallest id of their text all pass ``E``; an id with several rows in
``labels`` counts as good (or toxic) if one of them says so; other columns are not read and may have
any names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#$%&*|]"
FILTERS = "ABCDE"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, and mask: the failures that a text shows by itself (A to D)."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    tests = {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text"),
        "D": F.col("text").rlike(SYMBOL),
    }
    mask: Column = F.lit(0)
    for name, failed in tests.items():
        mask = mask + F.when(failed, _bit(name)).otherwise(0)
    return rows.select("doc_id", "part", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16).alias("digest"), mask.cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all filters), n, good and toxic: how many rows, and how many of them have such a label."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marks = marks.where("good = 1 or toxic = 1")
    rows = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # of a class of equal texts: its cells, each with its smallest id and the rows that have it
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    some = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"))
    some = some.withColumn("first", F.min("least.doc_id").over(W.partitionBy("digest")))
    passes = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    some = some.withColumn("passes", passes)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    split = some.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    steps = F.array(*[F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(_bit(x)).alias("bit")) for o in permutations(FILTERS) for i, x in enumerate(o)])
    long = cells(docs, labels).select("*", F.inline(steps))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    own = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("own", own).withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    alive, fails = F.col("earlier") == 0, F.col("own") != 0

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(F.lit(0))).cast("long")

    figures = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", alive & ~fails).alias("kept"),
        total("n", alive & fails).alias("removed"),
        total("n", ~alive & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", alive & fails).alias("good_lost"),
        total("toxic", alive & fails).alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")
