"""Reassembly of a transaction log: what every epoch of commits leaves in one shared store.

The log is dealt into blocks by ranges of (doc_id, text digest), as many as there are shuffle
partitions. In each block a stack machine for each source buffers changes and the offsets of
savepoints; it settles what the block decides and hands out the rest as open changes, with one
summary row a source: its first control record and its first end of a transaction. Windows over the
summaries of a source (one row a block at most) tell open changes what ended them in later blocks, so
a transaction may be as long as the log and no source's records meet in one task. Commits are
numbered by prefix sums inside blocks and over one row a block. Surviving writes are ordered by
(commit, doc_id); the last of each key and epoch is compared with the key's write before it by ``lag``
inside (key, chunk of epochs), a carried row standing for all earlier chunks; sums of these deltas are
added up by a prefix sum inside chunks and over one row a chunk. Only the sums of blocks and chunks, one row
each and as many as there are shuffle partitions, are broadcast; joins with labels and summaries are never.

Defined cases: rows without an id are no records; rows of one id come in the order of their text's
digest, then of their source, and equal rows one after the other; a null source is a source of its own;
a null text or a key that any row of ``labels`` calls toxic is a deletion; deletions are changes and are
reported when undone; an empty text is stored; text and label columns are all that is read, so other
columns may have any names; a log without commits has no states; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stash

#: Remainders of the id's crc32 by kind of record.
MODULUS = 41
COMMIT, ABORT, SAVEPOINT, ROLLBACK = (0, 1), (2,), (3, 4), (5, 6)
KEYS = 3000
#: Kinds as numbers inside the machine.
CHANGE, IS_COMMIT, IS_ABORT, IS_SAVEPOINT, IS_ROLLBACK = range(5)

EVENT = [("event", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("pos", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("crc", pa.int64())]
FATE = [("fate", pa.string()), ("fate_id", pa.int64()), ("fate_block", pa.int32()), ("fate_rank", pa.int64())]
SCHEMA = pa.schema(EVENT + FATE)
DDL = "event string, source string, block int, pos long, id long, key long, crc long, fate string, fate_id long, fate_block int, fate_rank long"


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, kind, source, key, crc (null: deletion) and digest of each log record; texts go no further."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rest = crc % MODULUS
    kind = F.when(rest.isin(*COMMIT), IS_COMMIT).when(rest.isin(*ABORT), IS_ABORT).when(rest.isin(*SAVEPOINT), IS_SAVEPOINT).when(rest.isin(*ROLLBACK), IS_ROLLBACK).otherwise(CHANGE)
    key = F.floor(crc / 100) % KEYS
    value = F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), kind.alias("kind"), F.col("source").cast("string").alias("source"),
        F.when(kind == CHANGE, key).alias("key"), F.when(kind == CHANGE, value).alias("crc"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("digest"),
    )
    deleted = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("id")).distinct().withColumn("gone", F.lit(True))
    return rows.join(deleted.hint("merge"), "id", "left").select("id", "kind", "source", "key", F.when(F.col("gone").isNull(), F.col("crc")).alias("crc"), "digest")


class Source:
    """The stack machine of one source inside one block.

    ``buffer`` has the remaining changes of the open transaction and ``savepoints`` the offsets in it.
    Whatever is below ``savepoints[-1]`` can't be undone by a rollback any more.
    """

    __slots__ = ("buffer", "savepoints", "first", "end")

    def __init__(self):
        self.buffer: list[tuple] = []
        self.savepoints: list[int] = []
        self.first: tuple | None = None  # the first control record of the block, (kind, id, rank)
        self.end: tuple | None = None  # the first commit or abort of the block

    def step(self, kind: int, id: int, rank: int) -> list[tuple]:
        """Take a control record; the changes that it settles."""
        if self.first is None:
            self.first = (kind, id, rank)
        if kind == IS_SAVEPOINT:
            self.savepoints.append(len(self.buffer))
            return []
        start = self.savepoints[-1] if kind == IS_ROLLBACK and self.savepoints else 0
        settled = self.buffer[start:]
        del self.buffer[start:]
        if kind != IS_ROLLBACK:
            self.savepoints.clear()
            if self.end is None:
                self.end = (kind, id, rank)
        return settled


NAMES = {IS_COMMIT: "commit", IS_ABORT: "abort", IS_ROLLBACK: "rollback", IS_SAVEPOINT: "savepoint"}


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of the log, in order, through the machines of its sources.

    Events: ``commit`` (rank in the block), ``change`` (settled here), ``open`` (fate ``bare``: a
    rollback may still undo it, ``kept``: a savepoint stands above it) and ``first``/``end`` of a source.
    """
    block, pos, commits = TaskContext.get().partitionId(), 0, 0
    machines: dict[str | None, Source] = {}
    out: list[tuple] = []

    def flush():
        columns = zip(*out, strict=True) if out else [[] for _ in SCHEMA]
        made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
        out.clear()
        return made

    for batch in batches:
        for id, kind, source, key, crc in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            machine = machines.get(source)
            if machine is None:
                machine = machines[source] = Source()
            if kind == CHANGE:
                machine.buffer.append((source, block, pos, id, key, crc))
            else:
                settled = machine.step(kind, id, commits)
                fate = (NAMES[kind], id, block, commits)
                out += [("change", *c, *fate) for c in settled]
                if kind == IS_COMMIT:
                    out.append(("commit", source, block, pos, id, None, None, *fate))
                    commits += 1
            pos += 1
        yield flush()
    for source, machine in machines.items():
        safe = machine.savepoints[-1] if machine.savepoints else 0
        out += [("open", *c, "kept" if i < safe else "bare", None, None, None) for i, c in enumerate(machine.buffer)]
        for event, found in (("first", machine.first), ("end", machine.end)):
            if found:
                out.append((event, source, block, -1, found[1], None, None, NAMES[found[0]], found[1], block, found[2]))
    yield flush()


def _settled(events: DataFrame) -> DataFrame:
    """All changes with their fate: ``commit``, ``abort`` or ``rollback``, and the record that decided it (null: the log's end)."""
    fate = F.struct("fate", "fate_id", "fate_block", "fate_rank")
    heads = events.where("event in ('first', 'end', 'open')").groupBy("source", "block").agg(
        F.max(F.when(F.col("event") == "first", fate)).alias("first"), F.max(F.when(F.col("event") == "end", fate)).alias("end")
    )
    later = W.partitionBy("source").orderBy("block").rowsBetween(1, W.unboundedFollowing)  # a row a block and source
    ahead = heads.select("source", "block", F.first("first", True).over(later).alias("next"), F.first("end", True).over(later).alias("ender"))
    open_ = events.where("event = 'open'").select("source", "block", "pos", "id", "key", "crc", F.col("fate").alias("state"))
    met = open_.alias("o").join(ahead.hint("merge").alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")) & (F.col("o.block") == F.col("a.block")))
    undone = (F.col("state") == "bare") & (F.col("next.fate") == "rollback")
    end = F.coalesce(F.when(undone, F.col("next")), F.col("ender"), F.expr("named_struct('fate', 'abort', 'fate_id', cast(null as long), 'fate_block', cast(null as int), 'fate_rank', cast(null as long))"))
    met = met.select("o.block", "pos", "id", "key", "crc", end.alias("f")).select("block", "pos", "id", "key", "crc", "f.*")
    return events.where("event = 'change'").select(met.columns).unionByName(met)


def _chunk(epoch: Column, epochs: int, chunks: int) -> Column:
    return F.floor((epoch - 1) * chunks / max(epochs, 1)).cast("int")


def reassemble(docs: DataFrame, labels: DataFrame, per_epoch: int = 16) -> DataFrame:
    """kind, id, n, value: a ``state`` row for each epoch and a row for each undone change."""
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "digest", "source"]
    log = records(docs, labels).repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("id", "kind", "source", "key", "crc")
    events = stash(log.mapInArrow(replay, DDL), "log-events")
    by_block = events.where("event = 'commit'").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # one row a block: the sum of all blocks before it, and one number for the driver
    before = by_block.select(F.col("block").alias("fate_block"), (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))
    total = by_block.agg(F.sum("n")).first()[0] or 0
    epochs = -(-total // per_epoch)

    numbered = (F.col("before") + F.col("fate_rank")).alias("commit")
    epoch = (F.floor(F.col("commit") / per_epoch) + 1).cast("long").alias("epoch")
    settled = stash(_settled(events), "log-settled")
    writes = settled.where("fate = 'commit'").join(F.broadcast(before), "fate_block").select("key", "crc", "block", "pos", numbered).select("*", epoch)
    last = F.max_by(F.struct("crc"), F.struct("commit", "block", "pos"))
    net = writes.groupBy("key", "epoch").agg(last.alias("to")).select("key", "epoch", F.col("to.crc").alias("crc"), _chunk(F.col("epoch"), epochs, blocks).alias("chunk"))
    net = stash(net, "log-net")
    ends = net.groupBy("key", "chunk").agg(F.max_by(F.struct("crc"), "epoch").alias("to"))
    # what a chunk starts from is the end of the key's chunk before: a row before its first epoch
    carried = ends.select("key", F.lit(0).cast("long").alias("epoch"), F.lag("to").over(W.partitionBy("key").orderBy("chunk")).getField("crc").alias("crc"), "chunk")
    at = W.partitionBy("key", "chunk").orderBy("epoch")
    moved = net.unionByName(carried).select("epoch", "crc", F.lag("crc").over(at).alias("old")).where("epoch > 0")
    there, was = F.col("crc").isNotNull().cast("long"), F.col("old").isNotNull().cast("long")
    moved = moved.select("epoch", (there - was).alias("dn"), (F.coalesce("crc", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("dv"))
    spine = events.where("event = 'commit'").join(F.broadcast(before), "fate_block").select(numbered).select(epoch, F.lit(0).cast("long").alias("dn"), F.lit(0).cast("long").alias("dv"))
    deltas = moved.unionByName(spine).groupBy("epoch").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    deltas = stash(deltas.withColumn("chunk", _chunk(F.col("epoch"), epochs, blocks)), "log-deltas")
    sums = deltas.groupBy("chunk").agg(F.sum("dn").alias("n0"), F.sum("dv").alias("v0"))
    earlier = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)  # one row a chunk
    offsets = sums.select("chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n0", "v0")])
    run = W.partitionBy("chunk").orderBy("epoch")
    states = deltas.join(F.broadcast(offsets), "chunk").select(
        F.lit("state").alias("kind"), F.col("epoch").alias("id"), (F.col("n0") + F.sum("dn").over(run)).alias("n"), (F.col("v0") + F.sum("dv").over(run)).alias("value")
    )
    undone = settled.where("fate <> 'commit'").select(F.col("fate").alias("kind"), "id", F.col("fate_id").alias("n"), F.col("key").alias("value"))
    return states.unionByName(undone)
