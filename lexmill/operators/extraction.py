"""Term extraction of whole texts: rankings by frequency and by burstiness, and what all of them agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import corpus, profiles, terms
from lexmill.operators.rounds import settled

#: Texts of at most so many characters are not worked on.
SHORTEST = 100


def rankings(docs: DataFrame, stop: list[str], sent_by_part: list[int] | None = None, parts: list[int] | None = None, min_count: int = 1, limit: int | None = None, key: str = "doc_id", most: int = 2) -> DataFrame:
    """key, algorithm, term, score and rank: ``freq``, and ``stdev-40s`` or ``stdev-8p`` for each way to cut a text.

    A text is cut into parts of ``sent_by_part`` sentences, or into ``parts``; ways that leave fewer than two parts are
    skipped, and a text without any way has no rankings. ``limit`` cuts each ranking.
    """
    if not (sent_by_part or parts) or min_count < 1 or (limit is not None and limit < 1) or any(x < 1 for x in [*(sent_by_part or []), *(parts or [])]):
        raise ValueError("ways to cut the text, counts and limits must be positive")
    docs = docs.where(F.length("text") > SHORTEST).select(key, "text")
    clock = corpus.word_clock(corpus.sentences(docs.repartition(key), key), key)  # dealt by key before texts are cut: what follows stays there
    ways = [(f"stdev-{k}s", F.expr(f"cast(n_sentences div {int(k)} as long)")) for k in sent_by_part] if sent_by_part else [(f"stdev-{p}p", F.lit(int(p)).cast("long")) for p in parts]
    ends = settled(profiles.ends_of(corpus.sentences(docs, key), key))
    cut = ends.select(key, F.inline(F.array(*[F.struct(F.lit(name).alias("algorithm"), n.alias("parts")) for name, n in ways]))).where("parts >= 2")
    occ = terms.candidates(clock, stop, most, key, carry=("t",))
    found = profiles.stdev_ranks(occ, clock, cut.select(key, "parts").distinct(), key, min_count, ends).join(cut, [key, "parts"])
    row = lambda name, score: F.struct(name.alias("algorithm"), score.alias("score"))
    bursts = found.groupBy(key, "term", "n").agg(F.collect_list(row(F.col("algorithm"), F.coalesce("score", F.lit(0.0)))).alias("bursts"))
    every = bursts.select(key, "term", F.inline(F.concat(F.array(row(F.lit("freq"), F.col("n").cast("double"))), "bursts")))
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy(key, "algorithm").orderBy(F.desc(F.round("score", 9)), "term")).cast("long"))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def agreed(ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the terms that are in all rankings of a text."""
    algorithms = ranked.groupBy(key).agg(F.countDistinct("algorithm").alias("every"))
    found = ranked.groupBy(key, "term").agg(F.countDistinct("algorithm").alias("n")).join(algorithms, key)
    return found.where("n = every").select(key, "term")
