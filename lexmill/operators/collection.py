"""Analytics over collections of documents (chapters of a book, articles of a topic)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.operators.profiles import interval, spread


def document_frequency(counts: DataFrame, *keys: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return counts.groupBy(*keys, "term").agg(count("doc_id").cast("long").alias("df"))


def chapter_relevance(counts: DataFrame, sizes: DataFrame, least: int = 1, min_score: float = 0.0, book: str = "book") -> DataFrame:
    """Chapters of a book with a term, by score; also how dense the term is compared with the book.

    ``counts`` (book, doc_id, term, n) and ``sizes`` (book, doc_id, words). The score multiplies by the
    chapter's share of words; density_ratio divides by it.
    """
    of_book = W.partitionBy(book)
    sized = sizes.select(book, "doc_id", "words", F.sum("words").over(of_book).alias("words_total"), F.count(F.lit(1)).over(of_book).alias("chapters"))
    kept = counts.where(F.col("n") >= least)
    totals = kept.groupBy(book, "term").agg(F.sum("n").alias("term_total"))
    found = kept.join(totals, [book, "term"]).join(sized, [book, "doc_id"])
    cols = {c: F.col(c).cast("double") for c in ("n", "term_total", "chapters", "words", "words_total")}
    rated = found.withColumn("score", scores.chapter_score(cols["n"], cols["term_total"], cols["chapters"], cols["words"], cols["words_total"]))
    ratio = (cols["n"] / cols["words"]) / (cols["term_total"] / cols["words_total"])
    return rated.withColumn("density_ratio", ratio).where(F.col("score") >= min_score).select(book, "term", "doc_id", "n", "score", "density_ratio")


def stdev_ranks(clocked: DataFrame, ends: DataFrame, found: Callable[..., DataFrame], parts: int | None = None, book: str = "book", key: str = "k") -> DataFrame:
    """Burstiness over the chapters of a book: each gets its share of ``parts`` (default: the number of chapters).

    ``clocked`` (key, sent_id, words, t) and ``ends`` (key, t0, total, n_sentences), where the key is a struct of book and
    chapter; ``found`` gives the occurrences of sentences and the columns that they carry. All chapters count with their
    bins, with or without the term. A sentence gets its bin before its terms are made, so chapters that were dealt by
    key are counted where they are, and only a term's sums are shuffled.
    """
    of_book = W.partitionBy(f"{key}.{book}")
    share = scores.parts_of(F.lit(parts) if parts else F.count(F.lit(1)).over(of_book), F.col("n_sentences"), F.sum("n_sentences").over(of_book))
    setup = ends.withColumn("parts", share).withColumn("width", interval(F.col("total"), F.col("parts")))
    setup = setup.withColumn("bins", F.floor((F.col("total") - F.col("t0")) / F.col("width")).cast("long") + 1).withColumn("all_bins", F.sum("bins").over(of_book))
    binned = clocked.select(key, "sent_id", "words", "t").join(setup.select(key, "t0", "width", "all_bins"), key)
    binned = binned.withColumn("bin", F.floor((F.col("t") - F.col("t0")) / F.col("width")).cast("long"))
    per_bin = found(binned, key=key, carry=("all_bins", "bin")).groupBy(key, "term", "n_words", "all_bins", "bin").agg(F.count(F.lit(1)).alias("x"))
    per_term = per_bin.groupBy(F.col(f"{key}.{book}").alias(book), "term", "n_words", "all_bins").agg(F.sum("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return per_term.withColumn("score", spread(F.col("n").cast("double"), F.col("q").cast("double"), F.col("all_bins")) * F.col("n_words"))


def terms_by_chapter(ranks: DataFrame, relevance: DataFrame, least: float = 1.0, book: str = "book") -> DataFrame:
    """Terms of each chapter: the term's score times the chapter's, for chapters that score at least ``least``."""
    found = ranks.select(book, "term", F.col("score").alias("rank_score")).join(relevance.where(F.col("score") >= least), [book, "term"])
    rated = found.withColumn("value", F.col("rank_score") * F.col("score"))
    return rated.withColumn("rank", F.row_number().over(W.partitionBy(book, "doc_id").orderBy(F.desc("value"), "term")).cast("long")).select(book, "doc_id", "rank", "term", "value")
