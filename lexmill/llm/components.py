"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash

#: Links (16 bytes each) up to which one task on an executor joins them; beyond, rounds over all tasks do.
ONE_TASK = 500_000


def _joined(links: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            for side in (label[x], label[y], x, y):
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])

    return links.repartition(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``links`` (a, b), long ids in any direction -> node and component, the smallest id reachable.

    Nodes without a link are not in the result. Each round writes its edges to the shared folder,
    and the rounds end when every edge points at its component's smallest node. All sums over a
    node's links are minima, combined before they are shuffled.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), label)
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return stash(_joined(edges), label)
    seen = None
    while True:
        edges = stash(edges, label)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
