"""What the registered queries share: tables, word lists, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import corpus, profiles, terms
from lexmill.operators.rounds import dealt, settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STOP = ["the", "of", "and", "to", "in", "a", "is", "it", "for", "that", "on", "en", "de", "la", "le", "les", "des", "que", "un", "une", "el", "los", "der", "die", "das", "und", "ist", "von"]
#: Words and phrases the example queries look for.
WANTED = ["the", "tion", "ing", "for", "les", "mente", "keit"]
PHRASES = ["of the", "the en", "to the", "de la", "in", "on the"]


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(documents(spark, sf_dir).select("doc_id", "text"))


def dealt_sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole texts that were dealt by key: what is grouped by text stays where it is."""
    return corpus.sentences(dealt(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))


def sents_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the book (source) of their document: the key is a struct that stays together."""
    docs = documents(spark, sf_dir).select(F.struct(F.col("source").alias("book"), "doc_id").alias("k"), "text")
    return corpus.sentences(docs, "k").select("k.book", "k.doc_id", "sent_id", "words", "n_words")


def clocked_with_ends(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sentences with the word clock, and the ends of the clock.

    Whole texts are dealt by key before they are cut, so everything that is grouped by text stays where it is.
    """
    ends = settled(profiles.ends_of(corpus.sentences(docs, key), key))
    return corpus.word_clock(corpus.sentences(dealt(docs, key), key), key), ends


def clocked(sentences: DataFrame) -> DataFrame:
    return corpus.word_clock(sentences)


def words_frame(spark: SparkSession, words: list[str], column: str = "word") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias(column))


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


WORD_RE = "[А-ЯЁа-яёA-Za-z]+(?:[-`''][\\p{L}\\p{N}_]+)*"


def sentence_sql(source: str = "documents", key: str = "doc_id") -> str:
    """CTEs ``sents`` and ``tokens``: the oracle's own way to split, by marks, as RE2 has no lookaround."""
    return f"""
    marked AS (
      SELECT {key}, regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'),
        '(\\n)\\s+([A-ZА-ЯЁ])', '\\1' || chr(2) || '\\2', 'g'), chr(2) || '([A-ZА-ЯЁ][A-ZА-ЯЁ])', ' \\1', 'g') AS m FROM {source}),
    pieces AS (SELECT {key}, regexp_split_to_array(m, '[' || chr(1) || chr(2) || ']') AS p FROM marked),
    lines AS (SELECT {key}, unnest(range(len(p)))::BIGINT AS sent_id, unnest(p) AS line FROM pieces),
    sents AS MATERIALIZED (
      SELECT * FROM (SELECT {key}, sent_id, words, len(words)::BIGINT AS n_words
        FROM (SELECT {key}, sent_id, list_transform(regexp_extract_all(line, '{WORD_RE}'), lambda x: lower(x)) AS words FROM lines)) WHERE n_words > 0),
    tokens AS (SELECT {key}, sent_id, unnest(range(len(words)))::BIGINT AS pos, unnest(words) AS word FROM sents)"""


PRE = "WITH RECURSIVE " + sentence_sql()
#: Sentences with the word clock, and its ends by document.
CLOCK = """,
    clocked AS MATERIALIZED (SELECT doc_id, sent_id, n_words, words, sum(n_words) OVER (PARTITION BY doc_id ORDER BY sent_id)::BIGINT AS t FROM sents),
    ends AS MATERIALIZED (SELECT doc_id, min(t) AS t0, max(t) AS total, count(*) AS n_sentences FROM clocked GROUP BY doc_id)"""
#: Candidate occurrences: one or two words of three letters or more, none a stop word.
CANDIDATES = f""",
    good AS (SELECT doc_id, sent_id, pos, word FROM tokens WHERE len(word) >= 3 AND word NOT IN ({quoted(STOP)})),
    occ AS MATERIALIZED (
      SELECT doc_id, sent_id, pos, word AS term, 1::BIGINT AS n_words FROM good
      UNION ALL
      SELECT a.doc_id, a.sent_id, a.pos, a.word || ' ' || b.word, 2 FROM good a JOIN good b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos = a.pos + 1)"""

STDEV = """CASE WHEN bins > 1 THEN sqrt(greatest(0, (q - s * s / bins) / (bins - 1))) * n_words END"""


def occurrences(sentences: DataFrame) -> DataFrame:
    """Candidates; those of clocked sentences carry the clock."""
    return terms.candidates(sentences, STOP, carry=("t",) if "t" in sentences.columns else ())


def book_occurrences(sentences: DataFrame) -> DataFrame:
    return terms.candidates(sentences, STOP, carry=("book",))


def rounded(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def parts_by_sentences(ends: DataFrame, per_part: list[int]) -> DataFrame:
    """parts = sentences div k for each k; values below 2 are skipped."""
    rows = ends.select("doc_id", "n_sentences", F.explode(F.array(*map(F.lit, per_part))).alias("k"))
    return rows.select("doc_id", "k", F.expr("n_sentences div k").alias("parts")).where("parts >= 2")
