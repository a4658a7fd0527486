"""Counts, positions, terms, n-grams and phrase matching on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import corpus, terms

from .base import CANDIDATES, PHRASES, PRE, STOP, WANTED, documents, occurrences, query, quoted, rounded, sentence_sql, sents, table, words_frame


@query(PRE + " SELECT doc_id, count(*)::BIGINT AS n_sentences FROM sents GROUP BY doc_id")
def sentences_per_doc(spark, d):
    return sents(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"))


@query(PRE + " SELECT doc_id, sum(n_words)::BIGINT AS n_words FROM sents GROUP BY doc_id")
def words_per_doc(spark, d):
    return sents(spark, d).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))


@query(PRE + " SELECT doc_id, count(*)::BIGINT AS n_sentences, sum(n_words)::BIGINT AS n_words FROM sents GROUP BY ROLLUP (doc_id)")
def collection_totals(spark, d):
    return corpus.totals(sents(spark, d), "doc_id")


@query(
    PRE
    + """, placed AS (SELECT doc_id, sent_id, n_words, sum(n_words) OVER w::BIGINT AS end_word, row_number() OVER w - 1 AS sentence_no FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id))
    SELECT doc_id, sent_id, n_words, end_word - n_words AS begin_word, end_word, sentence_no FROM placed""".replace("sum(n_words) OVER w::BIGINT", "(sum(n_words) OVER w)::BIGINT")
)
def sentence_positions(spark, d):
    return corpus.positions(sents(spark, d))


@query(PRE + " SELECT doc_id, sent_id, (sum(n_words) OVER (PARTITION BY doc_id ORDER BY sent_id))::BIGINT AS t FROM sents")
def cumulative_word_clock(spark, d):
    return corpus.word_clock(sents(spark, d)).select("doc_id", "sent_id", "t")


@query(PRE + " SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 100")
def word_freq_top(spark, d):
    return corpus.word_counts(sents(spark, d)).orderBy(F.desc("n"), "word").limit(100)


@query(PRE + " SELECT doc_id, word, count(*)::BIGINT AS n FROM tokens GROUP BY doc_id, word HAVING count(*) >= 5")
def term_freq_min_count(spark, d):
    return corpus.word_counts(sents(spark, d), "doc_id").where("n >= 5")


@query(PRE + f" SELECT word, count(*)::BIGINT AS n FROM tokens WHERE word NOT IN ({quoted(STOP)}) GROUP BY word")
def stopword_anti(spark, d):
    return terms.without_stopwords(corpus.word_counts(sents(spark, d)), words_frame(spark, STOP))


@query(PRE + f" SELECT DISTINCT word FROM tokens WHERE len(word) >= 3 AND NOT regexp_matches(word, '^[0-9]') AND word NOT IN ({quoted(STOP)})")
def vocabulary_filter(spark, d):
    return terms.vocabulary(corpus.tokens(sents(spark, d)), words_frame(spark, STOP))


def _counts(spark, d):
    return occurrences(sents(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(PRE + CANDIDATES + " SELECT term, count(*)::BIGINT AS n FROM occ WHERE term = 'with' GROUP BY term")
def find_terms_exact(spark, d):
    return terms.find_terms(_counts(spark, d), "with", exact=True)


@query(PRE + CANDIDATES + " SELECT term, count(*)::BIGINT AS n FROM occ WHERE contains(term, 'with') GROUP BY term ORDER BY n DESC, term LIMIT 50")
def find_terms_substr(spark, d):
    return terms.find_terms(_counts(spark, d), "with", limit=50)


@query(
    PRE
    + CANDIDATES
    + """, hits AS (SELECT doc_id, term, count(*) AS n FROM occ WHERE contains(term, 'thi') GROUP BY doc_id, term)
    SELECT row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)::BIGINT AS turn, doc_id, term FROM hits"""
)
def find_terms_interleaved(spark, d):
    hits = terms.frequencies(occurrences(sents(spark, d))).where(F.col("term").contains("thi"))
    listed = hits.withColumn("order", F.struct(-F.col("n"), F.col("term")))
    return terms.interleave(listed, "doc_id", "order", "term").select("turn", "doc_id", "term")


GRAMS = """,
    long_words AS (SELECT {key}, sent_id, list_filter(words, lambda w: len(w) >= 2) AS w FROM sents),
    grams AS (
      SELECT {key}, sent_id, n, unnest(list_transform(range(0, greatest(0, len(w) - n + 1)), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS gram
      FROM long_words, (SELECT unnest(range(1, 4)) AS n))"""


@query(PRE + GRAMS.format(key="doc_id") + " SELECT gram, n::BIGINT AS size, count(*)::BIGINT AS n FROM grams GROUP BY gram, size HAVING count(*) >= 2".replace("GROUP BY gram, size", "GROUP BY gram, grams.n"))
def ngrams_1_3(spark, d):
    rows = corpus.ngram_rows(sents(spark, d), 3)
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("gram", F.size(F.split("gram", " ")).cast("long").alias("size"), "n")


@query("WITH RECURSIVE " + sentence_sql("conversations", "conv_id, turn") + GRAMS.format(key="conv_id") + " SELECT DISTINCT conv_id, gram FROM grams")
def ngrams_distinct(spark, d):
    return terms.collocations(table(spark, d, "conversations").select("conv_id", "text"), 3, False, "conv_id").select("conv_id", "gram").distinct()


PHRASE = f""",
    starts AS (
      SELECT s.doc_id, s.sent_id, p.term, unnest(list_filter(range(0, greatest(0, len(words) - len(p.w) + 1)), lambda i: words[i + 1:i + len(p.w)] = p.w))::BIGINT AS start
      FROM sents s, (SELECT term, string_split(term, ' ') AS w FROM (VALUES {", ".join(f"('{p}')" for p in PHRASES)}) x(term)) p)"""


def _phrases(spark, d):
    wanted = words_frame(spark, PHRASES, "term_id").withColumn("words", F.split("term_id", " "))
    return terms.phrase_occurrences(corpus.tokens(sents(spark, d)), wanted).withColumnRenamed("term_id", "term")


@query(PRE + PHRASE + " SELECT doc_id, sent_id, term, start FROM starts")
def phrase_positions(spark, d):
    return _phrases(spark, d)


@query(PRE + PHRASE + " SELECT doc_id, term, count(*)::BIGINT AS n FROM starts GROUP BY doc_id, term")
def phrase_counts(spark, d):
    return _phrases(spark, d).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(PRE + f" SELECT doc_id, (count(*) FILTER (word IN ({quoted(WANTED)})))::BIGINT AS n FROM tokens GROUP BY doc_id")
def count_of_wordset(spark, d):
    return terms.count_of(sents(spark, d), WANTED)


@query(
    "SELECT doc_id, n_chars, (SELECT count(*) FROM documents b WHERE b.source = a.source)::BIGINT AS in_source FROM documents a WHERE len(text) >= 10000 ORDER BY len(text) DESC, doc_id"
)
def min_len_filter(spark, d):
    docs = documents(spark, d)
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("in_source"))
    return docs.where(F.length("text") >= 10_000).join(sizes, "source").orderBy(F.desc(F.length("text")), "doc_id").select("doc_id", "n_chars", "in_source")


@query("SELECT min(len(text))::BIGINT AS shortest, max(len(text))::BIGINT AS longest, round(avg(len(text)), 6) AS mean, count(*)::BIGINT AS n FROM documents")
def text_length_stats(spark, d):
    size = F.length("text").cast("long")
    return documents(spark, d).agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT k::BIGINT AS min_keywords, (SELECT count(*) FROM (SELECT doc_id FROM (SELECT doc_id, unnest([lang, source]) AS w FROM documents) GROUP BY doc_id HAVING count(DISTINCT w) >= k))::BIGINT AS n FROM range(0, 7) t(k)"
)
def docs_by_min_keywords(spark, d):
    """Documents by number of keywords (language and source), at least 0 to 6 of them."""
    sizes = documents(spark, d).select(F.size(F.array_distinct(F.array("lang", "source"))).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    ks = spark.range(7).withColumnRenamed("id", "min_keywords")
    return ks.join(F.broadcast(sizes), F.col("size") >= F.col("min_keywords"), "left").groupBy("min_keywords").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


@query("SELECT doc_id, unnest(list_filter(range(0, greatest(0, len(text) - 3)), lambda i: text[i + 1:i + 4] = 'ther'))::BIGINT AS place FROM documents")
def char_positions(spark, d):
    return documents(spark, d).select("doc_id", F.explode(tx.positions("ther", F.col("text"))).alias("place")).select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, round((strpos(text, '@') - 1) / len(text), 6) AS share FROM documents WHERE strpos(text, '@') > 0 AND (strpos(text, '@') - 1) / len(text) < 0.1")
def relative_first_pos(spark, d):
    share = tx.relative_position("@", F.col("text"))
    return documents(spark, d).select("doc_id", share.alias("share")).where("share < 0.1").select("doc_id", rounded("share"))


@query(PRE + " SELECT d.lang, s.doc_id, s.sent_id, (sum(n_words) OVER w)::BIGINT AS t, row_number() OVER w - 1 AS sentence_no FROM sents s JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY d.lang ORDER BY s.doc_id, s.sent_id)")
def long_word_clock(spark, d):
    """The word clock of all documents of a language read as one text."""
    rows = sents(spark, d).join(documents(spark, d).select("doc_id", "lang"), "doc_id").select("lang", "doc_id", "sent_id", "n_words")
    return corpus.long_clock(rows, ["lang"], ["doc_id", "sent_id"]).drop("n_words")
