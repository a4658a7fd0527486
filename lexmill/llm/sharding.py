"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to one of ``CELLS`` ring cells. A cell belongs to the arc that ends at the next virtual
node clockwise; that node's shard is the arc's first choice and the following distinct shards are
the next ones. Loads are bounded by exact quotas (row counts at most one apart): what a full shard
can't take continues clockwise. The rounds run on the counts by arc (``shards * vnodes`` of them,
whatever the number of rows), inside one SQL fold; rows are then placed by their rank in the arc.

Defined cases: a null text has size 1 and crc32 0; a null id is the empty key; repeated rows are
placed one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stash

#: Ring cells: the first 16 bits of the key's hash.
CELLS = 1 << 16


def ring(shards: int, vnodes: int = 64) -> list[dict]:
    """Arcs of the ring in order: the cells ``lo..hi`` of each and its shards in clockwise order."""
    nodes = sorted((int(md5(f"{s}:{v}".encode()).hexdigest()[:4], 16), s, v) for s in range(shards) for v in range(vnodes))
    arcs, lo = [], 0
    for i, (cell, _, _) in enumerate(nodes):
        if cell < lo:  # a node on the cell of the one before it ends no arc
            continue
        order = list(dict.fromkeys(nodes[(i + k) % len(nodes)][1] for k in range(len(nodes))))
        arcs.append({"arc": len(arcs), "lo": lo, "hi": cell, "shards": order})
        lo = cell + 1
    if lo < CELLS:  # past the last node the ring starts again
        arcs.append({"arc": len(arcs), "lo": lo, "hi": CELLS - 1, "shards": arcs[0]["shards"]})
    return arcs


def _fold(shards: int) -> str:
    """Rounds over (choice, arc): each arc gives what its shard of this round still has room for."""
    taken = "least(s.rest[x.arc], s.room[x.shard])"
    return f"""
    aggregate(
      flatten(transform(sequence(0, {shards - 1}), r -> transform(arcs, a -> named_struct('arc', a.arc, 'shard', a.shards[r])))),
      named_struct(
        'rest', transform(arcs, a -> a.n),
        'room', transform(sequence(0, {shards - 1}), k -> total div {shards} + if(k < total % {shards}, 1L, 0L)),
        'out', cast(array() as array<struct<arc: int, shard: int, rank_lo: bigint, rank_hi: bigint, slot_lo: bigint>>)),
      (s, x) -> if({taken} <= 0, s, named_struct(
        'rest', transform(s.rest, (v, i) -> if(i = x.arc, v - {taken}, v)),
        'room', transform(s.room, (v, i) -> if(i = x.shard, v - {taken}, v)),
        'out', concat(s.out, array(named_struct(
          'arc', x.arc, 'shard', x.shard,
          'rank_lo', arcs[x.arc].n - s.rest[x.arc],
          'rank_hi', arcs[x.arc].n - s.rest[x.arc] + {taken},
          'slot_lo', total div {shards} + if(x.shard < total % {shards}, 1L, 0L) - s.room[x.shard]))))),
      s -> s.out)"""


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = stash(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("at"),
        ).withColumn("cell", F.shiftright("at", 44).cast("int")),
        "ring-rows",
    )
    arcs = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(ring(shards, vnodes))), "array<struct<arc: int, lo: int, hi: int, shards: array<int>>>"))
    )
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = (
        arcs.select("arc", F.explode(F.sequence("lo", "hi")).alias("cell"))
        .join(counts, "cell", "left")
        .select("arc", "cell", F.coalesce("n", F.lit(0)).alias("n"))
    )
    by_arc = cells.groupBy("arc").agg(F.sum("n").alias("n"))
    places = (
        arcs.join(by_arc, "arc")
        .agg(F.array_sort(F.collect_list(F.struct("arc", "n", "shards"))).alias("arcs"), F.sum("n").alias("total"))
        .select(F.inline(F.expr(_fold(shards))))
    )
    before = cells.select("arc", "cell", (F.sum("n").over(W.partitionBy("arc").orderBy("cell")) - F.col("n")).alias("before"))
    in_cell = F.row_number().over(W.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")) - 1
    # both sides have a fixed bound: CELLS rows, and at most shards * arcs rows
    ranked = rows.withColumn("in_cell", in_cell).join(F.broadcast(before), "cell").withColumn("rank", F.col("before") + F.col("in_cell"))
    found = ranked.join(F.broadcast(places), "arc").where("rank >= rank_lo and rank < rank_hi")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot_lo") + F.col("rank") - F.col("rank_lo")).alias("slot"))


def shard_sql(shards: int = 8, vnodes: int = 64) -> str:
    """The same placement in DuckDB SQL, round by round with window sums."""
    arcs = ring(shards, vnodes)
    values = ", ".join(f"({a['arc']}, {a['lo']}, {a['hi']}, {a['shards']})" for a in arcs)
    rounds, state = [], "start"
    for r in range(shards):
        rounds.append(f"""
        t{r} AS MATERIALIZED (
          SELECT s.arc, s.n, s.rest, s.prefs, s.prefs[{r + 1}] AS shard, room.room,
                 greatest(0, least(s.rest, room.room - coalesce(sum(s.rest) OVER (PARTITION BY s.prefs[{r + 1}] ORDER BY s.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
          FROM {state} s JOIN room{r} room ON room.shard = s.prefs[{r + 1}]),
        g{r} AS MATERIALIZED (
          SELECT arc, shard, n - rest AS rank_lo, n - rest + taken AS rank_hi,
                 (SELECT quota FROM room0 q WHERE q.shard = t.shard) - room
                 + coalesce(sum(taken) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot_lo
          FROM t{r} t),
        s{r} AS MATERIALIZED (SELECT arc, n, rest - taken AS rest, prefs FROM t{r}),
        room{r + 1} AS MATERIALIZED (
          SELECT room.shard, room.quota, (room.room - coalesce((SELECT sum(taken) FROM t{r} t WHERE t.shard = room.shard), 0))::BIGINT AS room FROM room{r} room)""")
        state = f"s{r}"
    return f"""
    WITH arcs(arc, lo, hi, prefs) AS (VALUES {values}),
    keyed AS MATERIALIZED (
      SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {{crc}}::BIGINT AS text_crc32,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS at_
      FROM {{docs}}),
    ranked AS MATERIALIZED (
      SELECT k.*, a.arc, row_number() OVER (PARTITION BY a.arc ORDER BY at_, doc_id, text_crc32, size) - 1 AS rank
      FROM keyed k JOIN arcs a ON (at_ >> 44) BETWEEN a.lo AND a.hi),
    start AS MATERIALIZED (
      SELECT a.arc, a.prefs, count(r.arc) AS n, count(r.arc) AS rest FROM arcs a LEFT JOIN ranked r ON r.arc = a.arc GROUP BY a.arc, a.prefs),
    room0 AS MATERIALIZED (
      SELECT k::INT AS shard, (t.n // {shards} + CASE WHEN k < t.n % {shards} THEN 1 ELSE 0 END)::BIGINT AS quota,
             (t.n // {shards} + CASE WHEN k < t.n % {shards} THEN 1 ELSE 0 END)::BIGINT AS room
      FROM range({shards}) x(k), (SELECT count(*) AS n FROM keyed) t),
    {", ".join(x.strip() for x in rounds)},
    places AS ({" UNION ALL ".join(f"SELECT * FROM g{r}" for r in range(shards))})
    SELECT r.doc_id, r.size, r.text_crc32, p.shard, (p.slot_lo + r.rank - p.rank_lo)::BIGINT AS slot
    FROM ranked r JOIN places p ON r.arc = p.arc AND r.rank >= p.rank_lo AND r.rank < p.rank_hi"""
