"""A collection of books and their chapters, with the analytics of this package as methods."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import collection, corpus, profiles, terms
from lexmill.operators.rounds import dealt, settled


class Books:
    """Books made of chapters: rows of book, doc_id (the chapter) and text, in any number.

    Chapters without a sentence are left out. Sentences with their word clock are made once and kept in the shared
    folder; every method is a plan over them. ``with_chapters`` gives books with more chapters.
    """

    def __init__(self, chapters: DataFrame, stop: list[str], most: int = 2):
        self.chapters = chapters.select("book", "doc_id", "text")
        self.stop, self.most = stop, most

    def with_chapters(self, more: DataFrame) -> Books:
        return Books(self.chapters.unionByName(more.select("book", "doc_id", "text")), self.stop, self.most)

    @cached_property
    def sentences(self) -> DataFrame:
        """book, doc_id, sent_id, words, n_words and the clock t."""
        return settled(corpus.word_clock(self._dealt(), "k").select("k.book", "k.doc_id", "sent_id", "words", "n_words", "t"))

    def _dealt(self) -> DataFrame:
        """Sentences by k, book and doc_id of their chapter; whole chapters are dealt by it, so what is grouped by chapter stays in place."""
        return corpus.sentences(dealt(self.chapters.select(F.struct("book", "doc_id").alias("k"), "text"), "k"), "k")

    @cached_property
    def counts(self) -> DataFrame:
        """book, doc_id, term, n_words and n: candidates of each chapter."""
        return settled(self.occurrences().groupBy("book", "doc_id", "term", "n_words").agg(F.count(F.lit(1)).alias("n")))

    def occurrences(self) -> DataFrame:
        return terms.candidates(self.sentences, self.stop, self.most, carry=("book", "t"))

    def sizes(self) -> DataFrame:
        """book, chapters, n_sentences and n_words."""
        per_chapter = self.sentences.groupBy("book", "doc_id").agg(F.count(F.lit(1)).alias("s"), F.sum("n_words").alias("w"))
        return per_chapter.groupBy("book").agg(F.count(F.lit(1)).alias("chapters"), F.sum("s").alias("n_sentences"), F.sum("w").alias("n_words"))

    def count_of(self, words: DataFrame) -> DataFrame:
        """book, word and n for each of the ``words`` that a book has."""
        said = self.sentences.select("book", F.explode("words").alias("word"))
        return said.join(words.select("word").distinct(), "word", "left_semi").groupBy("book", "word").agg(F.count(F.lit(1)).alias("n"))

    def candidates(self, limit: int | None = None, least: int = 1) -> DataFrame:
        """book, term, n and rank of the books' candidates, counts of all chapters together."""
        found = self.counts.groupBy("book", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return terms.top(found, "n", 2**31 - 1 if limit is None else limit, "book")

    def find_terms(self, text: str, limit: int | None = None, exact: bool = False) -> DataFrame:
        return terms.find_terms(self.counts.groupBy("book", "term").agg(F.sum("n").alias("n")), text, limit, exact)

    def document_frequency(self) -> DataFrame:
        """book, term and the number of its chapters that have it: each chapter's terms are made distinct where it is, and counted."""
        found = terms.candidates(self._dealt(), self.stop, self.most, key="k").select("k", "term").distinct()
        return found.groupBy("k.book", "term").agg(F.count("k.doc_id").alias("df"))

    def chapters_with_terms(self, least: int = 1, min_score: float = 0.0) -> DataFrame:
        """Chapters in which a term counts for more than in the book: book, term, doc_id, n, score and density_ratio."""
        sizes = self.sentences.groupBy("book", "doc_id").agg(F.sum("n_words").alias("words"))
        return collection.chapter_relevance(self.counts.select("book", "doc_id", "term", "n"), sizes, least, min_score)

    def stdev_rank(self, parts: int | None = None, least: int = 1, limit: int | None = None) -> DataFrame:
        """book, term, n, score and rank by burstiness over all chapters."""
        held = self.sentences.select(F.struct("book", "doc_id").alias("k"), "sent_id", "words", "t")
        found = collection.stdev_ranks(held, profiles.clock_ends(held, "k"), partial(terms.candidates, stop=self.stop, most=self.most), parts).where(F.col("n") >= least)
        rows = found.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("by", F.round("score", 9))
        return terms.top(rows.select("book", "term", "n", "score", "by"), "by", 2**31 - 1 if limit is None else limit, "book").drop("by")

    def terms_by_chapter(self, parts: int | None = None, least: int = 1, min_score: float = 1.0) -> DataFrame:
        """Terms of each chapter, by their rank in the book times the chapter's score."""
        ranks = self.stdev_rank(parts, least).select("book", "term", "score")
        return collection.terms_by_chapter(ranks, self.chapters_with_terms(least), min_score)
