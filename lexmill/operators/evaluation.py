"""Evaluation of rankings against test sets: relevance, precision, recall, F1 and mean average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.operators import lemmas


def cross(rankings: DataFrame, tests: DataFrame, subject: str = "subject") -> DataFrame:
    """Each ranking of a subject with each of its test sets: subject, alg, expert."""
    return rankings.select(subject, "alg").distinct().join(tests.select(subject, "expert").distinct(), subject)


def short_labels(labels: DataFrame) -> DataFrame:
    """The shortest common prefix length of 1 to 9 that keeps labels distinct (else their whole length)."""
    cut = labels.select("label").distinct().select("label", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("size"))
    sizes = cut.groupBy("size").agg(F.countDistinct(F.substring("label", F.lit(1), F.col("size"))).alias("u"), F.count(F.lit(1)).alias("n"))
    best = sizes.where("u = n").agg(F.min("size").alias("size"))
    return labels.join(F.broadcast(best)).select("label", F.when(F.col("size").isNull(), F.col("label")).otherwise(F.substring("label", F.lit(1), F.col("size"))).alias("short"))


def relevance(ranked: DataFrame, tests: DataFrame, *keys: str, morph: DataFrame | None = None) -> DataFrame:
    """Relevance in [0, 1] of each ranked term to its best test item.

    1 for equal phrases, else (m / n_term) * (m / n_item) for the longest common run of m words.
    Runs meet by an equi-join; ``ranked`` has keys, rank, term and ``tests`` has keys, item. With
    ``morph`` two words are the same if they share a lemma.
    """
    if morph is not None:
        return _judged(ranked, _lemma_runs(ranked, tests, morph, *keys), *keys)
    spans = lambda c: F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(c)), lambda n: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.struct(n.alias("m"), F.array_join(F.slice(c, i + 1, n), " ").alias("run"))))
    )
    a = ranked.withColumn("w", F.split("term", " ")).select(*keys, "rank", "term", F.size("w").alias("n1"), F.explode(spans(F.col("w"))).alias("s"))
    b = tests.select(*keys, "item").distinct().withColumn("w", F.split("item", " ")).select(*keys, "item", F.size("w").alias("n2"), F.explode(spans(F.col("w"))).alias("s"))
    hits = a.select(*keys, "rank", "term", "n1", "s.m", "s.run").distinct().join(b.select(*keys, "item", "n2", "s.run").distinct(), [*keys, "run"])
    return _judged(ranked, hits, *keys)


def _lemma_runs(ranked: DataFrame, tests: DataFrame, morph: DataFrame, *keys: str) -> DataFrame:
    """Runs of m positions at which a term and an item share a lemma: maximal stretches of a diagonal."""
    a = lemmas.lemma_places(ranked, morph, "term", *keys).withColumnsRenamed({"size": "n1", "pos": "i"})
    b = lemmas.lemma_places(tests, morph, "item", *keys).withColumnsRenamed({"size": "n2", "pos": "j"})
    cells = a.join(b, [*keys, "lemma"]).select(*keys, "term", "item", "n1", "n2", "i", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    order = W.partitionBy(*keys, "term", "item", "diagonal").orderBy("i")
    runs = cells.withColumn("run", F.col("i") - F.row_number().over(order)).groupBy(*keys, "term", "item", "n1", "n2", "diagonal", "run").agg(F.count(F.lit(1)).alias("m"))
    best = runs.groupBy(*keys, "term").agg(F.max_by(F.struct("m", "n1", "n2"), (F.col("m") / F.col("n1")) * (F.col("m") / F.col("n2"))).alias("s")).select(*keys, "term", "s.*")
    return ranked.select(*keys, "rank", "term").join(best, [*keys, "term"])


def _judged(ranked: DataFrame, hits: DataFrame, *keys: str) -> DataFrame:
    best = hits.groupBy(*keys, "rank", "term").agg(F.max((F.col("m") / F.col("n1")) * (F.col("m") / F.col("n2"))).alias("relevance"))
    return ranked.select(*keys, "rank", "term").join(best, [*keys, "rank", "term"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def at_k(judged: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """precision, recall, f1 and ap (mean of the precisions of all ranks up to k) at every rank k.

    ``judged`` has keys, rank and relevance (rounded half to even here); ``items`` keys and n_items.
    """
    order = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = judged.withColumn("hit", F.bround("relevance")).withColumn("hits", F.sum("hit").over(order))
    rows = rows.withColumn("precision", F.col("hits") / F.col("rank")).withColumn("ap", F.avg("precision").over(order)).join(items, list(keys))
    rows = rows.withColumn("recall", F.col("hits") / F.col("n_items"))
    return rows.withColumn("f1", scores.f1(F.col("precision"), F.col("recall"))).select(*keys, F.col("rank").alias("k"), "precision", "recall", "f1", "ap")


def mean_by(values: DataFrame, column: str, *keys: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(column).alias(f"mean_{column}"), F.count(F.lit(1)).alias("observations"))


def partial_credit(selected: DataFrame, tests: DataFrame, *keys: str) -> DataFrame:
    """Each selected word inside a test phrase earns 1 / (words of the phrase); precision, recall and F1 of the sums."""
    phrases = tests.select(*keys, "item").distinct().withColumn("size", F.size(F.split("item", " ")))
    inside = phrases.select(*keys, "item", "size", F.explode(F.array_distinct(F.split("item", " "))).alias("term"))
    hits = selected.select(*keys, "term").join(inside, [*keys, "term"]).groupBy(*keys).agg(F.sum(1 / F.col("size")).alias("hits"))
    totals = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_selected")).join(phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items")), list(keys))
    rows = totals.join(hits, list(keys), "left").withColumn("hits", F.coalesce("hits", F.lit(0.0)))
    rows = rows.withColumn("precision", F.col("hits") / F.col("n_selected")).withColumn("recall", F.col("hits") / F.col("n_items"))
    return rows.withColumn("f1", scores.f1(F.col("precision"), F.col("recall"))).select(*keys, "precision", "recall", "f1")


def relative(values: DataFrame, base: str, column: str = "ap", *keys: str) -> DataFrame:
    """Each algorithm's value divided by the base algorithm's at the same k."""
    of_base = values.where(F.col("alg") == base).select(*keys, "k", F.col(column).alias("base"))
    return values.join(of_base, [*keys, "k"]).select(*keys, "k", "alg", F.when(F.col("base") != 0, F.col(column) / F.col("base")).alias("ratio"))


def eval_text(text, least: int = 100_000):
    """A text repeated until it has at least ``least`` characters."""
    return F.repeat(text, F.ceil(F.lit(least) / F.greatest(F.length(text), F.lit(1))).cast("int"))


def valid(evaluations: DataFrame, expert: str, least: int = 60) -> DataFrame:
    """Evaluations of an expert with at least ``least`` ranked terms and a test set that is not empty."""
    return evaluations.where((F.col("expert") == expert) & (F.col("n_ranked") >= least) & (F.col("n_items") > 0))


def named(rows: DataFrame, mark: str, column: str = "alg", without: bool = False) -> DataFrame:
    """Rows whose name holds ``mark``, or the other ones."""
    has = F.col(column).contains(mark)
    return rows.where(~has if without else has)
