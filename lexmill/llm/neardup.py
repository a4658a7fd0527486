"""Embedding near-duplicates: an epsilon grid order join on cosine similarity.

Equal vectors are one class with a weight. Unit vectors within an angle are within a distance
epsilon, also after projection to the leading principal dimensions. Vectors are sorted by their grid
cells (width epsilon) on those dimensions and cut into runs of up to eight blocks, with bounding boxes
of blocks and runs. The join is recursive over intervals of the sequence: runs meet if their first
cells are at most one apart and their boxes are within epsilon; a block goes to a pair of runs, once,
if its box is within epsilon of the other run; inside a task pairs of blocks are halved down to leaves,
and intervals whose boxes are farther apart are skipped. What is left is compared by matrix products:
a single-precision screen with a safe margin, then cosine in double precision. A pair of blocks gives
out link counts and spanning links by vector, never the links themselves.

Vectors without leading dimensions (spread evenly over many) lie in boxes wider than epsilon and are
then all compared; the join stays exact, and a vector is sent once a run, not once a block.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing,
as do vectors of different lengths; repeated vec_ids are counted as separate vectors and each row
is returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import partition_sums, small, stash

#: Vectors of a block (fewer of more than 64 components), and of an interval that is no longer halved.
BLOCK, LEAF = 2048, 256
#: Blocks of a run, of which one task holds one at a time.
RUN = 8
#: Leading principal dimensions of the grid order.
DIMS = 6


def _units(raw: np.ndarray) -> np.ndarray:
    # scaling by the largest component first keeps very large and very small vectors finite
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _principal(classes: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of the unit vectors."""

    def moments(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            u = np.hstack([_units(_vectors(b.column(0), d)), np.ones((b.num_rows, 1))])
            total += u.T @ u
        return total.ravel()

    m = partition_sums(classes.select("embedding"), moments, (d + 1, d + 1))
    mean = m[d, :d] / max(m[d, d], 1.0)
    _, axes = np.linalg.eigh(m[:d, :d] / max(m[d, d], 1.0) - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1][:, : min(DIMS, d)])


def _blocks(classes: DataFrame, d: int, eps: float, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Sequence blocks of the grid order: the block's run, ids, weights, vectors, first cells and bounding box."""
    k, size = axes.shape[1], max(LEAF, BLOCK * 64 // max(d, 64))

    def cells(batches):
        for b in batches:
            at = (_units(_vectors(b.column(1), d)) - mean) @ axes
            grid = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(at / eps).astype(np.int32).ravel()), k).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), grid], ["rep", "embedding", "weight", "grid"])

    def cut(batches):
        rows, ids = [], 0
        first = TaskContext.get().partitionId() << 32

        def block(parts):
            nonlocal ids
            rep, raw, weight = (np.concatenate(x) for x in zip(*parts))
            at = (_units(raw) - mean) @ axes
            lo, hi = at.min(axis=0), at.max(axis=0)
            cell = np.floor(np.array([lo[0], hi[0]]) / eps).astype(np.int64)
            values = [first + ids, first + ids // RUN, int(cell[0]), int(cell[1]), list(lo), list(hi), rep.tobytes(), weight.tobytes(), raw.tobytes()]
            ids += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["block", "run", "c_lo", "c_hi", "lo", "hi", "ids", "weights", "vectors"])

        n = 0
        for b in batches:
            part = (np.asarray(b.column(0)), _vectors(b.column(1), d), np.asarray(b.column(2)))
            at = 0
            while at < b.num_rows:
                take = min(size - n, b.num_rows - at)
                rows.append(tuple(x[at : at + take] for x in part))
                n, at = n + take, at + take
                if n == size:
                    yield block(rows)
                    rows, n = [], 0
        if n:
            yield block(rows)

    gridded = stash(classes.select("rep", "embedding", "weight").mapInArrow(cells, "rep long, embedding array<double>, weight long, grid array<int>"), "ego-grid")
    parts = max(1, math.ceil(gridded.count() / (RUN * size)))
    order = [F.col("grid")[i] for i in range(k)]
    sequence = gridded.repartitionByRange(parts, *order, "rep").sortWithinPartitions(*order, "rep") if parts > 1 else gridded.coalesce(1).sortWithinPartitions(*order, "rep")
    kinds = "block long, run long, c_lo long, c_hi long, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary"
    return stash(sequence.select("rep", "embedding", "weight").mapInArrow(cut, kinds), "ego-blocks")


def _halve(a, b, eps2: float, pa_: np.ndarray, pb: np.ndarray):
    """Pairs of intervals of two sequences whose boxes are within epsilon, down to leaves."""
    todo = [(a, b)]
    while todo:
        (i, j), (k, m) = todo.pop()
        gap = np.maximum(0.0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if (gap * gap).sum() > eps2:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield i, j, k, m
        elif j - i >= m - k:
            mid = (i + j) // 2
            todo += [((i, mid), (k, m)), ((mid, j), (k, m))]
        else:
            mid = (k + m) // 2
            todo += [((i, j), (k, mid)), ((i, j), (mid, m))]


def _roots(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``labels`` (indices, each no larger than its position) after joining the groups of x and y."""
    while True:
        low = np.minimum(labels[x], labels[y])
        before = labels.copy()
        np.minimum.at(labels, labels[x], low)
        np.minimum.at(labels, labels[y], low)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _side(ids, weights, raw, mean, axes):
    """A block as it is compared: ids, weights, vectors, unit vectors (double and single), projections."""
    unit = _units(raw)
    return ids, weights, raw, unit, unit.astype(np.float32), (unit - mean) @ axes


def compare(one, two, cosine: float, same: bool):
    """Link weights of every vector of two blocks, and the smallest position it reaches through links here."""
    (ids1, w1, raw1, u1, f1, p1), (ids2, w2, raw2, u2, f2, p2) = one, two
    eps2 = 2 - 2 * cosine + 1e-9
    n1, n2 = np.zeros(len(ids1), np.int64), np.zeros(len(ids2), np.int64)
    labels = np.arange(len(ids1) + len(ids2))
    for i, j, k, m in _halve((0, len(ids1)), (0, len(ids2)), eps2, p1, p2):
        if same and k >= j:
            continue
        near = f1[i:j] @ f2[k:m].T >= cosine - 1e-4
        if not near.any():
            continue
        x, y = np.nonzero(near)
        if same:
            x, y = x[x + i > y + k], y[x + i > y + k]
        value = np.einsum("ij,ij->i", u1[x + i], u2[y + k])
        for q in np.flatnonzero(np.abs(value - cosine) < 1e-12):
            a, b = raw1[x[q] + i], raw2[y[q] + k]
            value[q] = math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))
        x, y = x[value >= cosine] + i, y[value >= cosine] + k
        if len(x):
            np.add.at(n1, x, w2[y])
            np.add.at(n2, y, w1[x])
            labels = _roots(labels, x, y + len(ids1))
    return n1, n2, labels


def _gap(a_lo, a_hi, b_lo, b_hi):
    """Squared distance of two boxes."""
    apart = F.zip_with(F.arrays_zip(a_lo.alias("lo"), a_hi.alias("hi")), F.arrays_zip(b_lo.alias("lo"), b_hi.alias("hi")), lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"]))
    return F.aggregate(apart, F.lit(0.0), lambda t, g: t + g * g)


def _met(blocks: DataFrame, k: int, eps: float) -> DataFrame:
    """Pairs of runs (a before or equal b) whose boxes are within epsilon, each once, with the boxes."""
    corner = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(k)])
    runs = stash(blocks.groupBy("run").agg(F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"), corner(F.min, "lo").alias("lo"), corner(F.max, "hi").alias("hi")), "ego-runs")
    box = lambda s, reach: runs.select(
        *[F.col(c).alias(f"{c}_{s}") for c in ("run", "lo", "hi")], (F.col("c_lo") - reach).alias(f"from_{s}"), F.explode(F.sequence(F.col("c_lo") - reach, F.col("c_hi") + reach)).alias("cell")
    )
    met = box("a", 1).join(box("b", 0), "cell").where("run_a <= run_b AND cell = greatest(from_a, from_b)")
    met = met.where(_gap(*(F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b"))) <= eps * eps + 1e-9)
    return stash(met.select("run_a", "run_b", "lo_a", "hi_a", "lo_b", "hi_b"), "ego-runs-met")


def _linked(classes: DataFrame, d: int, cosine: float) -> DataFrame:
    """rep, other (a vector it is linked to through links, or itself) and n (weight of links found at once)."""
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    mean, axes = _principal(classes, d)
    blocks = _blocks(classes, d, eps, mean, axes)
    met = _met(blocks, axes.shape[1], eps)

    def members(s: str, other: str) -> DataFrame:
        within = _gap(F.col("lo"), F.col("hi"), F.col(f"lo_{other}"), F.col(f"hi_{other}")) <= eps * eps + 1e-9
        pairs = met if s == "a" else met.where("run_a < run_b")
        sent = blocks.join(small(pairs), F.col("run") == F.col(f"run_{s}")).where(within)
        return sent.select("run_a", "run_b", F.lit(s).alias("side"), "block", "ids", "weights", "vectors")

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(j) for j in range(7))))
        for (a, b), tile in itertools.groupby(rows, lambda row: (row[0].as_py(), row[1].as_py())):
            held = []
            for row in tile:
                ids, weights, raw = np.frombuffer(row[4].as_py(), np.int64), np.frombuffer(row[5].as_py(), np.int64), np.frombuffer(row[6].as_py(), np.float64).reshape(-1, d)
                side = _side(ids, weights, raw, mean, axes)
                if row[2].as_py() == "a":
                    held.append(side)
                for one in held if a == b or row[2].as_py() == "b" else ():
                    n1, n2, labels = compare(one, side, cosine, one is side)
                    both, n = np.concatenate([one[0], ids]), np.concatenate([n1, n2])
                    found = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(both[found]), pa.array(both[labels[found]]), pa.array(n[found])], ["rep", "other", "n"])

    sent = members("a", "b").unionByName(members("b", "a"))
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(width, "run_a", "run_b").sortWithinPartitions("run_a", "run_b", "side", "block").mapInArrow(run, "rep long, other long, n long")


def link(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0.0), F.lit(False)
    )
    rows = stash(rows.select("vec_id", F.when(fit, F.col("embedding")).alias("embedding")), "ego-rows")
    classes = stash(
        rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "ego-classes"
    )
    lengths = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().orderBy("d").limit(1025).collect()]
    if len(lengths) > 1024:
        raise ValueError("vectors of more than 1024 different lengths")
    found = spark.createDataFrame([], "rep long, other long, n long")
    for d in lengths:
        found = found.unionByName(_linked(classes.where(F.size("embedding") == d), d, cosine))
    found = stash(found, "ego-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    names = classes.select("rep", "low", "weight")
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), "ego-components")
    named = names.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    keyed = classes.select("rep", "embedding").join(named, "rep").select("embedding", "n_links", "component_id")
    placed = rows.where("embedding is not null").join(keyed, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


LINK_SQL = """
    WITH RECURSIVE good AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e FROM {vectors}
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
      SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
    reach(v, c) AS (
      SELECT vec_id, vec_id FROM good
      UNION
      SELECT l.vb, r.c FROM reach r JOIN links l ON l.va = r.v)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, v.vec_id)::BIGINT AS component_id, v.vec_id = coalesce(c.c, v.vec_id) AS kept
    FROM {vectors} v LEFT JOIN (SELECT va, count(*) AS n FROM links GROUP BY va) n ON n.va = v.vec_id
    LEFT JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) c ON c.v = v.vec_id"""
