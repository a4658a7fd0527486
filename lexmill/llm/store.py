"""Tables, shared storage and partition sums."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast after its rows were counted.
BROADCAST_ROWS = 50_000
#: Partial results that a task, or the driver, adds up.
FAN_IN = 16
#: Bytes of a payload that come to the driver in one row, and in one task's result.
PIECE = 1 << 18
#: Settings of a write: shuffle files go when it is done, and batches for Python hold a few megabytes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the files.

    The session's settings are as before after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill/{label}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete the files of stashes that nothing reads any more."""
    for df in stashed:
        jvm, path = df.sparkSession._jvm, df._stashed_at
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unmarked (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _brought(level: DataFrame, size: int) -> list[bytearray]:
    """The payloads of ``level`` (part, payload), ``size`` bytes in all, in the order of parts.

    They come in pieces: Spark's driver holds several copies of each row and each task's result that it
    receives, and makes room for large ones in addition to all it has.
    """
    if size > PIECE:

        def cut(batches):
            for batch in batches:
                for part, payload in zip(batch.column(0), batch.column(1)):
                    raw = payload.as_buffer()
                    for at in range(0, max(1, raw.size), PIECE):
                        yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([at], pa.int64()), pa.array([raw[at : at + PIECE].to_pybytes()], pa.binary())], ["part", "at", "payload"])

        level = level.select("part", "payload").mapInArrow(cut, "part int, at long, payload binary").repartition(-(-size // PIECE))
    else:
        level = level.select("part", F.lit(0).cast("long").alias("at"), "payload")
    rows = level.collect()
    out: dict[int, bytearray] = {}
    for r in sorted(rows, key=lambda r: (r.part, r.at)):
        out.setdefault(r.part, bytearray()).extend(r.payload)
    return list(out.values())


def gather(df: DataFrame, first: Callable[[Iterator[pa.RecordBatch]], bytes | None], add: Callable[[Iterator[bytes]], bytes], left: int = FAN_IN) -> list[bytearray]:
    """What ``first`` makes of each partition, added up by ``add`` until at most ``left`` of them are left.

    Each level deals the payloads by partition id, ``FAN_IN`` to a task: no task and not the driver
    receives more, however many partitions there are.
    """
    kind = "part int, size long, payload binary"

    def row(payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(payload)], pa.int64()), pa.array([payload], pa.binary())], ["part", "size", "payload"])

    def begin(batches):
        payload = first(batches)
        if payload is not None:
            yield row(payload)

    def again(batches):
        raw = (x.as_py() for batch in batches for x in batch.column(2))
        head = next(raw, None)
        if head is not None:
            yield row(add(itertools.chain([head], raw)))

    level = stash(df.mapInArrow(begin, kind), "sums")
    while (known := level.agg(F.max("part"), F.sum("size")).first())[0] is not None and known[0] >= left:
        dealt = level.repartitionById(known[0] // FAN_IN + 1, F.floor(F.col("part") / FAN_IN).cast("int"))
        following = stash(dealt.mapInArrow(again, kind), "sums")
        discard(level)
        level = following
    out = _brought(level, known[1] or 0)
    discard(level)
    return out


def partition_sums(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over partitions of the float64 arrays that ``fold`` makes of each partition's batches."""

    def first(batches):
        total = fold(batches)
        return None if total is None else np.ascontiguousarray(total, np.float64).tobytes()

    def add(payloads):
        total = np.zeros(int(np.prod(shape)))
        for raw in payloads:
            total += np.frombuffer(raw, np.float64)
        return total.tobytes()

    found = gather(df, first, add, left=1)  # one sum, or none of an empty table
    return np.frombuffer(found[0], np.float64).reshape(shape) if found else np.zeros(shape)


def held_out(doc_id: str = "doc_id", by: int = 5, rest: int = 0):
    """crc32 of the id as text, modulo ``by``, equals ``rest``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by == rest
