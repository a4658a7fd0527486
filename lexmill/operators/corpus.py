"""Documents to sentences, tokens and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import text as tx


def sentences(docs: DataFrame, key: str = "doc_id", letters: str = "reference") -> DataFrame:
    """key, sent_id, words, n_words. Sentences without words are left out but keep their ordinal.

    Words come out of a generator, so that no filter above it makes them a second time.
    """
    lines = docs.select(key, F.posexplode(tx.sentences(F.col("text"))).alias("sent_id", "line"))
    found = lines.select(key, F.col("sent_id").cast("long").alias("sent_id"), F.explode(F.array(tx.words(F.col("line"), letters))).alias("words"))
    return found.withColumn("n_words", F.size("words").cast("long")).where("n_words > 0")


def tokens(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    return sents.select(key, "sent_id", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def positions(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Half-open word range [begin_word, end_word) and the running number of each sentence, and the word clock t."""
    order = W.partitionBy(key).orderBy("sent_id")
    t = F.sum("n_words").over(order.rowsBetween(W.unboundedPreceding, 0))
    return sents.select(key, "sent_id", "n_words", (t - F.col("n_words")).alias("begin_word"), t.alias("end_word"), (F.row_number().over(order) - 1).cast("long").alias("sentence_no"))


def word_clock(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """t: words up to and with each sentence."""
    return sents.withColumn("t", F.sum("n_words").over(W.partitionBy(key).orderBy("sent_id").rowsBetween(W.unboundedPreceding, 0)))


def long_clock(sents: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``t`` and ``sentence_no`` (from 0) of each sentence in texts of any length: a key may be a whole corpus."""
    from lexmill.operators import scans

    found = scans.running(sents.withColumn("_one", F.lit(1).cast("long")), keys, order, t="n_words", sentence_no="_one")
    return found.withColumn("sentence_no", F.col("sentence_no") - 1).drop("_one")


def totals(sents: DataFrame, *keys: str) -> DataFrame:
    """Sentences and words by each prefix of the keys and over everything, in one pass."""
    return sents.rollup(*keys).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_words").alias("n_words"))


def word_counts(sents: DataFrame, *keys: str) -> DataFrame:
    return sents.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def ngram_rows(sents: DataFrame, most: int, key: str = "doc_id", shortest: int = 2) -> DataFrame:
    """One row a 1..``most``-gram of a sentence; grams never cross sentences."""
    return sents.select(key, "sent_id", F.explode(tx.ngrams(F.col("words"), most, shortest)).alias("gram"))
