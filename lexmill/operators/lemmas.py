"""Lemma patterns of phrases: each word stands for the set of its lemmas, and phrases match position by position.

``morph`` is a table (word, lemma); a word it lacks is its own lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemma_places(phrases: DataFrame, morph: DataFrame, phrase: str = "phrase", *keys: str) -> DataFrame:
    """keys, the phrase, size, pos and lemma: one row a lemma of each word of each distinct phrase."""
    words = phrases.select(*keys, phrase).distinct().withColumn("w", F.filter(F.split(phrase, r"\s+"), lambda x: x != ""))
    placed = words.select(*keys, phrase, F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
    found = placed.join(morph.select("word", F.col("lemma").alias("_lemma")).distinct(), "word", "left")
    return found.select(*keys, phrase, "size", "pos", F.coalesce("_lemma", "word").alias("lemma")).distinct()


def lemma_patterns(phrases: DataFrame, morph: DataFrame, phrase: str = "phrase") -> DataFrame:
    """The phrase and its pattern: an array of sorted lemma arrays."""
    by_place = lemma_places(phrases, morph, phrase).groupBy(phrase, "pos").agg(F.array_sort(F.collect_set("lemma")).alias("ls"))
    return by_place.groupBy(phrase).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ls"))), lambda x: x["ls"]).alias("lemmas"))


def same_lemmas(phrases: DataFrame, terms: DataFrame, morph: DataFrame) -> DataFrame:
    """Pairs (phrase, term) of the same length that share a lemma at every position.

    The equi-join is on length and lemmas of the first and the last word; the other words are compared in the joined row.
    """
    a = lemma_patterns(phrases, morph)
    b = lemma_patterns(terms, morph, "term").withColumnRenamed("lemmas", "others")
    ends = lambda df, name, c: df.select(name, c, F.size(c).alias("size"), F.explode(F.element_at(c, 1)).alias("first")).select("*", F.explode(F.element_at(c, -1)).alias("last"))
    same = F.forall(F.zip_with("lemmas", "others", lambda x, y: F.arrays_overlap(x, y)), lambda x: x)
    return ends(a, "phrase", "lemmas").join(ends(b, "term", "others"), ["size", "first", "last"]).where(same).select("phrase", "term").distinct()


def fitting(phrases: DataFrame, supers: DataFrame, morph: DataFrame) -> DataFrame:
    """Phrases each of whose words has a lemma among the super-terms (size, pos, lemma) of their length at its place."""
    hits = lemma_places(phrases, morph).join(supers.select("size", "pos", "lemma"), ["size", "pos", "lemma"], "left_semi")
    return hits.groupBy("phrase", "size").agg(F.countDistinct("pos").alias("n")).where("n = size").select("phrase")
