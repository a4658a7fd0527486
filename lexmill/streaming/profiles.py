"""Occurrence profiles of texts that arrive piece by piece: a tumbling window on the word clock of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def binned(sents: DataFrame, wanted: list[str], width: int, key: str = "doc_id") -> DataFrame:
    """Counts of wanted words by bin of ``width`` words: key, bin, term, n (no zeros). A batch.

    As in ``profiles.compressed`` bins start at the clock after the first sentence; a sentence counts where it ends.
    """
    from lexmill.operators import corpus

    clock = corpus.word_clock(sents, key)
    first = clock.groupBy(key).agg(F.min("t").alias("t0"))
    words = clock.select(key, "t", F.explode("words").alias("term")).where(F.col("term").isin(*wanted)).join(first, key)
    return words.groupBy(key, F.floor((F.col("t") - F.col("t0")) / width).cast("long").alias("bin"), "term").agg(F.count(F.lit(1)).alias("n"))


def binned_stream(sents: DataFrame, wanted: list[str], width: int, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """The rows of ``binned`` from a stream of sentences (key, sent_id, words, is_last), a bin as soon as the clock has passed it.

    State of a text: its clock, where its bins start, the open bin and its counts, read and written once a batch; a few numbers,
    whatever the text's length. Of sentences only their sizes and wanted words leave the JVM. Sentences of a text must come in order from batch to batch (inside a batch they are put in order);
    one that comes again after a failure, or late, is older than the clock and leaves it as it is. The sentence marked
    ``is_last`` closes the text. With ``buckets`` texts whose keys have one hash share a group and a row of state, each with
    numbers of its own: a group and its state cost some milliseconds, however little is in it. It may not change while a stream goes on.
    """
    kind = sents.schema[key].dataType.simpleString()
    bucket = F.xxhash64(key) if buckets is None else F.pmod(F.xxhash64(key), F.lit(buckets))
    hits = F.filter("words", lambda w: w.isin(*wanted)).alias("hits")
    sents = sents.select(bucket.alias("bucket"), F.col(key).cast("string").alias(key), "sent_id", F.size("words").alias("size"), hits, "is_last")

    def run(_, rows, state):
        import pandas as pd

        texts = {}
        for pdf in rows:
            for name, *row in zip(*(pdf[c].tolist() for c in (key, "sent_id", "size", "hits", "is_last"))):
                texts.setdefault(name, []).append(row)
        held = {x[0]: x[1:] for x in zip(*state.get)} if state.exists else {}
        out = []
        for name, sentences in texts.items():
            t0, t, bin_, last, names, numbers = held.get(name, (-1, 0, 0, -1, [], []))
            counts = dict(zip(names, numbers))

            def close():
                out.extend((name, bin_, term, n) for term, n in sorted(counts.items()))
                counts.clear()

            for sent, size, found, ends in sorted(sentences, key=lambda r: r[0]):
                if sent <= last:
                    continue
                last, t = sent, t + size
                t0 = t if t0 < 0 else t0
                if (t - t0) // width != bin_:
                    close()
                    bin_ = (t - t0) // width
                for w in found:
                    counts[w] = counts.get(w, 0) + 1
                if ends:
                    close()
            held[name] = t0, t, bin_, last, list(counts), list(counts.values())
        state.update(tuple(map(list, zip(*((name, *x) for name, x in held.items())))))
        if out:
            yield pd.DataFrame(out, columns=[key, "bin", "term", "n"])

    # the state comes and goes with the rows, in the same Arrow batches
    kept = "texts array<string>, t0 array<long>, t array<long>, bin array<long>, last array<long>, terms array<array<string>>, counts array<array<long>>"
    found = sents.groupBy("bucket").applyInPandasWithState(run, f"{key} string, bin long, term string, n long", kept, "append", "NoTimeout")
    return found.select(F.col(key).cast(kind).alias(key), "bin", "term", "n")


def run_to_table(spark: SparkSession, source: str, sink: str, checkpoint: str, wanted: list[str], width: int, key: str = "doc_id", files: int = 1, buckets: int | None = None) -> None:
    """Read Parquet files of sentences as a stream, ``files`` a batch in the order of their times, and append closed bins until the input ends.

    Started again on the same ``checkpoint`` it goes on with the files that came since. The session's state store is
    as before after it.
    """
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
        found = binned_stream(rows, wanted, width, key, buckets)
        found.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
