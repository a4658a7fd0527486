"""Readers and writers: each query writes files derived from the tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import corpus, profiles, rounds
from lexmill.sources import files, store

from .base import CLOCK, PRE, STDEV, clocked, documents, parts_by_sentences, query, rounded, sents, table
from .ranking_queries import RANKED


@query("SELECT item_id::INTEGER AS item_id, text || chr(10) AS text FROM benchmark WHERE text IS NOT NULL")
def whole_text_files(spark, d):
    """A file for each item, read whole, with its line ends."""
    path = rounds.scratch(spark, "whole")
    table(spark, d, "benchmark").where("text is not null").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    return files.whole_text(spark, path).select(F.col("item_id").cast("int").alias("item_id"), "text")


@query(r"SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM benchmark) WHERE word <> ''")
def wordset_file(spark, d):
    path = rounds.scratch(spark, "words")
    table(spark, d, "benchmark").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return files.wordset(spark, path)


@query("SELECT value, count(*)::BIGINT AS n FROM (SELECT CASE doc_id % 4 WHEN 1 THEN lang WHEN 2 THEN source END AS value FROM documents) WHERE value IS NOT NULL GROUP BY value")
def commented_file(spark, d):
    """Lines without comments: of four kinds of lines one is a comment, one empty, one ends in a comment."""
    path = rounds.scratch(spark, "commented")
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  # "), "lang")).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit(" # "), "source")).when(F.col("doc_id") % 4 == 2, F.col("source")).otherwise("")
    documents(spark, d).select(line.alias("value")).write.text(path)
    return files.commented_lines(spark, path, cut_comments=True).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(w[1]) || ' ' || lower(w[2]) AS concept FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) >= 2")
def expert_file(spark, d):
    """Concepts of two words, joined by the mark of the expert lists."""
    path = rounds.scratch(spark, "experts")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    table(spark, d, "benchmark").select(words.alias("w")).where("size(w) >= 2").select(F.concat_ws("::", F.lower(F.col("w")[0]), F.lower(F.col("w")[1])).alias("value")).write.text(path)
    return files.expert_list(spark, path).select(F.array_join("words", " ").alias("concept"))


def _topics(spark, d):
    """Previews of all documents by language, saved in two goes."""
    path = rounds.scratch(spark, "topics")
    previews = documents(spark, d).select(F.col("doc_id").alias("number"), F.coalesce("lang", F.lit("")).alias("topic"), F.concat(F.lit("/article/n/"), "source").alias("url"), F.concat("source", F.lit(" "), "lang").alias("title"))
    store.merge_topics(spark, previews.where("number % 3 = 0"), path)
    store.merge_topics(spark, previews.where("number % 3 <> 0"), path)
    return path


@query("SELECT doc_id AS number, source || ' ' || lang AS title FROM documents WHERE lang = 'en'")
def topic_files(spark, d):
    """The previews of one topic of a folder that was saved in two goes."""
    return files.topic_previews(spark, _topics(spark, d), "en").select("number", "title")


@query("SELECT lang AS topic, doc_id AS number, doc_id || chr(9) || substr(md5(source), 1, 8) || '.pkl' || chr(9) || source || ' ' || lang AS line FROM documents")
def topic_listings(spark, d):
    """The lines of the topics' listings: number, file name and title."""
    previews = spark.read.parquet(_topics(spark, d))
    return store.topic_listing(previews, tx.hex_id(tx.last_path_part(F.col("url"))))


def _stored(spark, d):
    """Documents saved by number: a part of them, all of them, and all again."""
    path = rounds.scratch(spark, "store")
    rows = documents(spark, d).select(F.col("doc_id").alias("number"), F.when(F.col("lang") == "en", "ok").otherwise("bad").alias("status"), "source", F.lit("first").alias("save"))
    store.save(rows.where("number % 2 = 0"), path, "number", buckets=16)
    for _ in range(2):
        store.save(rows.withColumn("save", F.lit("second")), path, "number")
    return path


@query("SELECT doc_id AS number, CASE WHEN lang = 'en' THEN 'ok' ELSE 'bad' END AS status, source, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS save FROM documents")
def stored_articles(spark, d):
    """What a store holds after saves that overlap: each number once, as it was saved first."""
    return store.read(spark, _stored(spark, d))


@query("SELECT doc_id AS number, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents UNION SELECT max(doc_id) FROM documents)")
def stored_lookup(spark, d):
    """The records of two numbers, read from their buckets only."""
    ends = documents(spark, d).agg(F.min("doc_id"), F.max("doc_id")).first()
    return store.lookup(spark, _stored(spark, d), *ends).select("number", "source")


@query(
    "SELECT doc_id AS number, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
)
def save_new_articles(spark, d):
    """Rows appended to plain files in two goes, those that are there left out, read back without their marks."""
    path = rounds.scratch(spark, "plain")
    wanted = documents(spark, d).join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = wanted.select(F.col("doc_id").alias("number"), F.when(F.col("lang") == "en", "ok").otherwise("bad").alias("status"), "source")
    files.save_new(rows.where("number % 2 = 0"), path, "number")
    files.save_new(rows, path, "number")
    return spark.read.parquet(path).select(F.abs("number").alias("number"), "source")


COMMON = " common AS (SELECT word FROM tokens GROUP BY word HAVING count(*) >= 200)"


@query(PRE + "," + COMMON + " SELECT '# min_count: 200' AS value UNION ALL SELECT '' UNION ALL SELECT word FROM common")
def terms_file(spark, d):
    """The lines of a result: parameters, an empty line, the terms."""
    path = rounds.scratch(spark, "terms")
    common = corpus.word_counts(sents(spark, d)).where("n >= 200").select(F.col("word").alias("term"))
    files.write_terms(common, path, min_count=200)
    return spark.read.text(path)


@query(PRE + "," + COMMON + " SELECT word AS term FROM common")
def dumped_result(spark, d):
    path = rounds.scratch(spark, "dump")
    files.stored_result(corpus.word_counts(sents(spark, d)).where("n >= 200").select(F.col("word").alias("term")), path)
    return spark.read.parquet(path)


@query("SELECT page_id, (page_id % 9 + 2)::INTEGER AS last_page FROM pages")
def last_pages(spark, d):
    """The last page of a listing, from its links to pages."""
    link = lambda n: F.concat(F.lit('<a href="/c/x/page/'), n.cast("string"), F.lit('">.</a>'))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), link(F.lit(1)), link(F.col("page_id") % 9 + 2), link(F.lit(2))).alias("html"))
    return pages.select("page_id", files.last_page(F.col("html")).alias("last_page"))


#: Units: words and phrases that count as one.
UNITS = {"definite": ["the", "of the", "to the"], "romance": ["la", "de la", "les"]}
UNIT_ROWS = ", ".join(f"('{u}', '{p}')" for u, ps in UNITS.items() for p in ps)
UNIT_OCC = f""",
    units(unit, phrase) AS (VALUES {UNIT_ROWS}),
    grams AS (SELECT doc_id, sent_id, pos, word AS phrase FROM tokens UNION ALL SELECT a.doc_id, a.sent_id, a.pos, a.word || ' ' || b.word FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND b.pos = a.pos + 1),
    occ AS MATERIALIZED (SELECT g.doc_id, g.sent_id, g.pos, u.unit AS term, 1::BIGINT AS n_words FROM grams g JOIN units u ON u.phrase = g.phrase)"""


def _units(spark):
    rows = F.array(*[F.struct(F.lit(u).alias("term"), F.split(F.lit(p), " ").alias("words")) for u, ps in UNITS.items() for p in ps])
    return spark.range(1).select(F.inline(rows))


@query(PRE + UNIT_OCC + " SELECT doc_id, term, count(*)::BIGINT AS n FROM occ GROUP BY doc_id, term")
def unit_counts(spark, d):
    """Occurrences of units: lists of words and phrases that count as one."""
    found = profiles.unit_occurrences(clocked(sents(spark, d)), _units(spark))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(PRE + CLOCK + UNIT_OCC + RANKED.format(ks="10", stdev=STDEV, least=2) + " SELECT doc_id, term, parts::BIGINT AS parts, n, score FROM ranks")
def unit_stdev_rank(spark, d):
    """Burstiness of units in a document."""
    clock = clocked(sents(spark, d))
    found = profiles.stdev_ranks(profiles.unit_occurrences(clock, _units(spark)), clock, parts_by_sentences(profiles.clock_ends(clock, "doc_id"), [10]).select("doc_id", "parts"))
    return found.where("n >= 2").select("doc_id", "term", F.col("parts").cast("long").alias("parts"), "n", rounded("score"))
