"""Profiles, burstiness rankings, collections, correlations and word families."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import book, collection, corpus, extraction, families, profiles, rounds, sketches, terms
from lexmill.streaming import profiles as stream_profiles

from .base import CANDIDATES, CLOCK, PRE, STDEV, STOP, WANTED, book_occurrences, clocked, clocked_with_ends, dealt_sents, documents, occurrences, parts_by_sentences, query, quoted, rounded, sents, sents_of_books, table, words_frame

RAW = f""",
    raw AS (SELECT doc_id, w AS term, t, len(list_filter(words, lambda x: x = w))::BIGINT AS n FROM clocked, (SELECT unnest([{quoted(WANTED)}]) AS w))"""
BINS = """,
    setup AS (SELECT *, ceil(total / {parts})::BIGINT AS width FROM ends),
    summed AS (SELECT r.doc_id, r.term, (r.t - s.t0) // width AS bin, sum(n)::BIGINT AS n FROM raw r JOIN setup s USING (doc_id) GROUP BY ALL),
    grid AS (SELECT doc_id, unnest(range(0, (total - t0) // width + 1)) AS bin FROM setup),
    bins AS MATERIALIZED (
      SELECT g.doc_id, n.term, g.bin::BIGINT AS bin, coalesce(s.n, 0)::BIGINT AS n
      FROM grid g JOIN (SELECT DISTINCT doc_id, term FROM raw) n USING (doc_id) LEFT JOIN summed s ON s.doc_id = g.doc_id AND s.term = n.term AND s.bin = g.bin)"""


@query(PRE + CLOCK + RAW + " SELECT doc_id, term, t, n FROM raw")
def raw_profile(spark, d):
    return profiles.raw_profile(sents(spark, d), WANTED)


@query(PRE + CLOCK + " SELECT doc_id, p::BIGINT AS parts, ceil(total / p)::BIGINT AS width FROM ends, (SELECT unnest([2, 5, 10, 40]) AS p)")
def resample_interval(spark, d):
    ends = profiles.clock_ends(clocked(sents(spark, d)), "doc_id")
    rows = ends.select("doc_id", "total", F.explode(F.array(*[F.lit(p).cast("long") for p in (2, 5, 10, 40)])).alias("parts"))
    return rows.select("doc_id", "parts", profiles.interval(F.col("total"), F.col("parts")).alias("width"))


def _bins(spark, d, parts):
    s = sents(spark, d)
    return profiles.compressed(profiles.raw_profile(s, WANTED), profiles.clock_ends(clocked(s), "doc_id"), parts)


@query(PRE + CLOCK + RAW + BINS.format(parts=10) + " SELECT doc_id, term, bin, n FROM bins")
def compressed_profile(spark, d):
    return _bins(spark, d, 10)


@query(
    PRE
    + f""", clocked AS (SELECT doc_id, sent_id, words, sum(n_words) OVER (PARTITION BY doc_id ORDER BY sent_id) AS t FROM sents),
    starts AS (SELECT doc_id, min(t) AS t0 FROM clocked GROUP BY doc_id),
    hits AS (SELECT doc_id, t, unnest(words) AS term FROM clocked)
    SELECT h.doc_id, ((h.t - s.t0) // 200)::BIGINT AS bin, h.term, count(*)::BIGINT AS n FROM hits h JOIN starts s ON s.doc_id = h.doc_id WHERE h.term IN ({quoted(WANTED)}) GROUP BY ALL"""
)
def profile_stream(spark, d):
    """Bins of 200 words of each document, emitted by a stream that reads the documents in three batches."""
    s = dealt_sents(spark, d)
    last = W.partitionBy("doc_id")
    rows = s.select("doc_id", "sent_id", "words", (F.col("sent_id") == F.max("sent_id").over(last)).alias("is_last"), (F.col("sent_id") * 3 / (F.max("sent_id").over(last) + 1)).cast("int").alias("batch"))
    source, sink, check = (rounds.scratch(spark, f"profile-{x}") for x in ("in", "out", "check"))
    rows = rounds.settled(rows)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(3):  # a text's sentences of a batch are in one file
        rows.where(F.col("batch") == i).drop("batch").repartition(files, "doc_id").write.mode("append").parquet(source)
    buckets = max(files, documents(spark, d).count() // 64)
    stream_profiles.run_to_table(spark, source, sink, check, WANTED, 200, files=files, buckets=buckets)
    return spark.read.schema("doc_id long, bin long, term string, n long").parquet(sink)


RANKED = """,
    counted AS (SELECT doc_id, term, n_words, sent_id, count(*) AS x FROM occ GROUP BY ALL),
    setup AS (
      SELECT doc_id, t0, total, k, n_sentences // k AS parts, ceil(total / (n_sentences // k))::BIGINT AS width, (total - t0) // ceil(total / (n_sentences // k))::BIGINT + 1 AS bins
      FROM ends, (SELECT unnest([{ks}]) AS k) WHERE n_sentences // k >= 2),
    per_bin AS (
      SELECT c.doc_id, c.term, c.n_words, s.k, s.parts, s.bins, (l.t - s.t0) // s.width AS bin, sum(x) AS x
      FROM counted c JOIN clocked l ON l.doc_id = c.doc_id AND l.sent_id = c.sent_id JOIN setup s ON s.doc_id = c.doc_id GROUP BY ALL),
    per_term AS (SELECT doc_id, term, n_words, k, parts, bins, sum(x) AS s, sum(x * x) AS q FROM per_bin GROUP BY ALL),
    ranks AS MATERIALIZED (SELECT doc_id, term, k, parts, s::BIGINT AS n, round({stdev}, 6) AS score FROM per_term WHERE s >= {least})"""


def _ranks(spark, d, ks, least):
    clock, ends = clocked_with_ends(documents(spark, d).select("doc_id", "text"))
    parts = parts_by_sentences(ends, ks)
    found = profiles.stdev_ranks(occurrences(clock), clock, parts.select("doc_id", "parts").distinct(), least=least, ends=ends)
    return found.join(parts, ["doc_id", "parts"]).select("doc_id", "term", F.col("k").cast("long").alias("k"), F.col("parts").cast("long").alias("parts"), "n", rounded("score"))


@query(PRE + CLOCK + CANDIDATES + RANKED.format(ks="10", stdev=STDEV, least=3) + " SELECT doc_id, term, k::BIGINT AS k, parts::BIGINT AS parts, n, score FROM ranks")
def stdev_rank(spark, d):
    return _ranks(spark, d, [10], 3)


@query(PRE + CLOCK + CANDIDATES + RANKED.format(ks="5, 10, 20, 40", stdev=STDEV, least=5) + " SELECT doc_id, term, k::BIGINT AS k, parts::BIGINT AS parts, n, score FROM ranks")
def stdev_rank_multi_parts(spark, d):
    return _ranks(spark, d, [5, 10, 20, 40], 5)


def flagship(spark, d, per_part=10, least=3, most=30):
    """Terms that are among the first both by frequency and by burstiness, for each document."""
    clock, ends = clocked_with_ends(documents(spark, d).select("doc_id", "text"))
    parts = parts_by_sentences(ends, [per_part]).select("doc_id", "parts")
    found = profiles.stdev_ranks(occurrences(clock), clock, parts, least=least, ends=ends).select("doc_id", "term", "n", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    place = lambda c: F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(c), "term")).cast("long")
    ranked = found.withColumn("freq_rank", place("n")).withColumn("stdev_rank", place("score"))
    return ranked.where((F.col("freq_rank") <= most) & (F.col("stdev_rank") <= most)).select("doc_id", "term", "n", "freq_rank", "stdev_rank", "score")


FLAGSHIP_SQL = (
    PRE
    + CLOCK
    + CANDIDATES
    + RANKED.format(ks="10", stdev=STDEV, least=3)
    + """, both_ranks AS (
      SELECT doc_id, term, n, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS freq_rank,
             row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, term) AS stdev_rank FROM ranks)
    SELECT doc_id, term, n, freq_rank::BIGINT AS freq_rank, stdev_rank::BIGINT AS stdev_rank, score FROM both_ranks WHERE freq_rank <= 30 AND stdev_rank <= 30"""
)
query(FLAGSHIP_SQL, "freq_stdev_intersection")(flagship)


@query(
    PRE
    + CLOCK
    + CANDIDATES
    + RANKED.format(ks="5, 10", stdev=STDEV, least=3)
    + """, tops AS (SELECT * FROM (SELECT doc_id, k, term, row_number() OVER (PARTITION BY doc_id, k ORDER BY coalesce(score, 0) DESC, term) AS r FROM ranks) WHERE r <= 20)
    SELECT doc_id, term, CASE WHEN bool_or(k = 5) AND bool_or(k = 10) THEN 'both' WHEN bool_or(k = 5) THEN 'only 5' ELSE 'only 10' END AS found FROM tops GROUP BY doc_id, term"""
)
def rank_union_diff(spark, d):
    """Union of the first 20 terms at two settings, with intersection and differences."""
    ranks = _ranks(spark, d, [5, 10], 3).withColumn("score", F.coalesce("score", F.lit(0.0)))
    tops = terms.top(ranks, "score", 20, "doc_id", "k")
    has = lambda k: F.bool_or(F.col("k") == k)
    return tops.groupBy("doc_id", "term").agg(F.when(has(5) & has(10), "both").when(has(5), "only 5").otherwise("only 10").alias("found"))


@query(
    PRE.replace("FROM documents", "FROM (SELECT * FROM documents WHERE len(text) > 100)")
    + CLOCK
    + CANDIDATES
    + RANKED.format(ks="5, 10", stdev=STDEV, least=3)
    + """, every_rank AS (
      SELECT doc_id, 'stdev' || k AS alg, term, round(coalesce(score, 0), 6) AS score FROM ranks
      UNION ALL SELECT doc_id, 'freq', term, count(*) FROM occ WHERE doc_id IN (SELECT doc_id FROM setup) GROUP BY doc_id, term HAVING count(*) >= 3),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, alg ORDER BY score DESC, term) AS r FROM every_rank) WHERE r <= 30),
    asked AS (SELECT doc_id, count(DISTINCT alg) AS every FROM cut GROUP BY doc_id)
    SELECT c.doc_id, c.term FROM cut c JOIN asked a ON a.doc_id = c.doc_id GROUP BY c.doc_id, c.term, a.every HAVING count(DISTINCT alg) = a.every"""
)
def process_text(spark, d):
    """The terms all rankings of a document agree on, as the command line extracts them."""
    return extraction.agreed(extraction.rankings(documents(spark, d), STOP, sent_by_part=[5, 10], min_count=3, limit=30))


BOOK = """,
    books AS (SELECT doc_id, source AS book FROM documents),
    book_counts AS MATERIALIZED (SELECT b.book, o.doc_id, o.term, o.n_words, count(*) AS n FROM occ o JOIN books b USING (doc_id) GROUP BY ALL)"""


@query(PRE + CANDIDATES + BOOK + " SELECT book, term, sum(n)::BIGINT AS n, string_agg(DISTINCT term, ' ') AS first_words FROM book_counts GROUP BY book, term HAVING sum(n) >= 3")
def merge_similar_terms(spark, d):
    counts = book_occurrences(sents_of_books(spark, d)).groupBy("book", "doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    merged = terms.merge_similar(counts.withColumn("words", F.split("term", " ")).withColumn("ord", F.col("doc_id")), "book")
    return merged.where("n >= 3").select("book", "term", "n", F.array_join("words", " ").alias("first_words"))


@query(
    PRE
    + CANDIDATES
    + BOOK
    + """, merged AS (SELECT book, term, sum(n)::BIGINT AS n FROM book_counts GROUP BY book, term)
    SELECT * FROM (SELECT book, term, n, row_number() OVER (PARTITION BY book ORDER BY n DESC, term)::BIGINT AS rank FROM merged) WHERE rank <= 50"""
)
def booklet_candidates(spark, d):
    counts = book_occurrences(sents_of_books(spark, d)).groupBy("book", "term").agg(F.count(F.lit(1)).alias("n"))
    return terms.top(counts, "n", 50, "book")


@query(PRE + " SELECT word AS term, count(DISTINCT doc_id)::BIGINT AS df FROM tokens GROUP BY word")
def document_frequency(spark, d):
    return collection.document_frequency(corpus.word_counts(sents(spark, d), "doc_id").withColumnRenamed("word", "term"))


def _books(spark, d):
    return book.Books(documents(spark, d).select(F.col("source").alias("book"), "doc_id", "text"), STOP)


@query(PRE + " SELECT d.source AS book, count(DISTINCT s.doc_id)::BIGINT AS chapters, count(*)::BIGINT AS n_sentences, sum(n_words)::BIGINT AS n_words FROM sents s JOIN documents d USING (doc_id) GROUP BY d.source")
def book_sizes(spark, d):
    return _books(spark, d).sizes()


@query(PRE + f" SELECT d.source AS book, t.word, count(*)::BIGINT AS n FROM tokens t JOIN documents d USING (doc_id) WHERE t.word IN ({quoted(WANTED)}) GROUP BY ALL")
def book_count_of(spark, d):
    return _books(spark, d).count_of(words_frame(spark, WANTED))


@query(PRE + CANDIDATES + BOOK + " SELECT book, term, count(DISTINCT doc_id)::BIGINT AS df FROM book_counts GROUP BY book, term")
def book_document_frequency(spark, d):
    return _books(spark, d).document_frequency()


@query()
def document_frequency_approx(spark, d):
    return collection.document_frequency(corpus.word_counts(sents(spark, d), "doc_id").withColumnRenamed("word", "term"), approximate=True)


@query()
def document_frequency_sketch(spark, d):
    """Estimates from stored sketches: those of the languages, taken in one after the other and merged by term."""
    docs = documents(spark, d).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    counts = corpus.word_counts(sents(spark, d), "doc_id").withColumnRenamed("word", "term").join(docs, "doc_id")
    path = rounds.scratch(spark, "sketches")
    sketches.document_frequency(counts, "lang").write.partitionBy("lang").parquet(path)
    stored = spark.read.parquet(path)
    return sketches.estimate(sketches.merge(sketches.add(stored, stored, "lang", "term"), "term"), "df")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, TRUE AS near FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY event_type")
def daily_sketches_merged(spark, d):
    """Users of each type of event, and whether the estimate from a sketch a day is within 6 % (four standard errors) of them."""
    rows = table(spark, d, "events").where("ts is not null and user_id is not null").select("event_type", F.to_date("ts").alias("day"), "user_id")
    found = sketches.estimate(sketches.merge(sketches.sketch(rows, "user_id", "event_type", "day"), "event_type"), "estimate")
    exact = rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(found, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.06 * F.col("users")).alias("near"))


RELEVANT = (
    PRE
    + f""",
    books AS (SELECT doc_id, source AS book FROM documents),
    sizes AS (SELECT b.book, s.doc_id, sum(n_words) AS words FROM sents s JOIN books b USING (doc_id) GROUP BY ALL),
    sized AS (SELECT *, sum(words) OVER (PARTITION BY book) AS words_total, count(*) OVER (PARTITION BY book) AS chapters FROM sizes),
    hits AS (SELECT b.book, t.doc_id, t.word AS term, count(*) AS n FROM tokens t JOIN books b USING (doc_id) WHERE t.word IN ({quoted(WANTED)}) GROUP BY ALL HAVING count(*) >= 2),
    rated AS (
      SELECT h.book, h.term, h.doc_id, h.n, h.n::DOUBLE / sum(h.n) OVER (PARTITION BY h.book, h.term) * chapters * words / words_total * chapters AS score,
             (h.n::DOUBLE / words) / (sum(h.n) OVER (PARTITION BY h.book, h.term)::DOUBLE / words_total) AS density_ratio
      FROM hits h JOIN sized s ON s.book = h.book AND s.doc_id = h.doc_id)"""
)


def _relevance(spark, d, min_score):
    s = sents_of_books(spark, d)
    counts = s.select("book", "doc_id", F.explode("words").alias("term")).where(F.col("term").isin(WANTED)).groupBy("book", "doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return collection.chapter_relevance(counts, s.groupBy("book", "doc_id").agg(F.sum("n_words").alias("words")), 2, min_score)


@query(RELEVANT + " SELECT book, term, doc_id, n::BIGINT AS n, round(score, 6) AS score, round(density_ratio, 6) AS density_ratio FROM rated WHERE score >= 0.5")
def chapters_with_term(spark, d):
    return _relevance(spark, d, 0.5).select("book", "term", "doc_id", "n", rounded("score"), rounded("density_ratio"))


def _book_stdev(parts):
    return f"""{PRE}{CLOCK}{CANDIDATES}{BOOK},
    setup0 AS (
      SELECT e.*, b.book, greatest(1, round_even({parts or 'count(*) OVER (PARTITION BY b.book)'} * n_sentences::DOUBLE / sum(n_sentences) OVER (PARTITION BY b.book), 0))::BIGINT AS parts
      FROM ends e JOIN books b USING (doc_id)),
    setup AS (
      SELECT *, ceil(total / parts)::BIGINT AS width, sum((total - t0) // ceil(total / parts)::BIGINT + 1) OVER (PARTITION BY book) AS bins FROM setup0),
    per_bin AS (
      SELECT s.book, o.term, o.n_words, s.bins, o.doc_id, (l.t - s.t0) // s.width AS bin, count(*) AS x
      FROM occ o JOIN clocked l ON l.doc_id = o.doc_id AND l.sent_id = o.sent_id JOIN setup s ON s.doc_id = o.doc_id GROUP BY ALL),
    per_term AS (SELECT book, term, n_words, bins, sum(x) AS s, sum(x * x) AS q FROM per_bin GROUP BY ALL),
    ranks AS MATERIALIZED (SELECT book, term, s::BIGINT AS n, round({STDEV}, 6) AS score FROM per_term WHERE s >= 3 AND len(term) >= 2)"""


def _book_ranks(spark, d, parts):
    clock, ends = clocked_with_ends(documents(spark, d).select(F.struct(F.col("source").alias("book"), "doc_id").alias("k"), "text"), "k")
    ranks = collection.stdev_ranks(clock, ends, partial(terms.candidates, stop=STOP), parts)
    return ranks.where((F.col("n") >= 3) & (F.length("term") >= 2)).select("book", "term", "n", rounded("score"))


@query(_book_stdev(100) + " SELECT book, term, n, score FROM ranks")
def booklet_stdev_rank(spark, d):
    return _book_ranks(spark, d, 100)


@query(_book_stdev(None) + " SELECT * FROM (SELECT book, term, n, score, row_number() OVER (PARTITION BY book ORDER BY coalesce(score, -1) DESC, term)::BIGINT AS rank FROM ranks) WHERE rank <= 100")
def rank_candidates_stdev(spark, d):
    rows = _book_ranks(spark, d, None).withColumn("by", F.coalesce("score", F.lit(-1.0)))
    return terms.top(rows, "by", 100, "book").select("book", "term", "n", "score", "rank")


@query(
    RELEVANT
    + f""", term_ranks AS (SELECT b.book, word AS term, count(*)::DOUBLE AS s FROM tokens t JOIN books b USING (doc_id) WHERE word IN ({quoted(WANTED)}) GROUP BY ALL),
    valued AS (SELECT r.book, r.doc_id, r.term, round(t.s * r.score, 6) AS value FROM rated r JOIN term_ranks t ON t.book = r.book AND t.term = r.term WHERE r.score >= 1)
    SELECT book, doc_id, row_number() OVER (PARTITION BY book, doc_id ORDER BY value DESC, term)::BIGINT AS rank, term, value FROM valued"""
)
def terms_by_chapter(spark, d):
    s = sents_of_books(spark, d)
    ranks = s.select("book", F.explode("words").alias("term")).where(F.col("term").isin(WANTED)).groupBy("book", "term").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return collection.terms_by_chapter(ranks, _relevance(spark, d, 0.0)).withColumn("value", F.round("value", 6))


CORR = """,
    pairs AS (SELECT a.doc_id, a.term AS w1, b.term AS w2, a.n::DOUBLE AS n1, b.n::DOUBLE AS n2 FROM {src} a JOIN {src} b ON a.doc_id = b.doc_id AND a.bin = b.bin),
    corrs AS (SELECT doc_id, w1, w2, CASE WHEN min(n1) < max(n1) AND min(n2) < max(n2) THEN corr(n1, n2) END AS corr FROM pairs GROUP BY ALL)"""


@query(PRE + CLOCK + RAW + BINS.format(parts=10) + CORR.format(src="bins") + " SELECT doc_id, w1, w2, round(corr, 5) + 0 AS corr FROM corrs WHERE w1 < w2 AND corr IS NOT NULL")
def profile_corr(spark, d):
    corr = profiles.correlations(_bins(spark, d, 10), "doc_id")
    return profiles.pair_statistics(corr).select("doc_id", "w1", "w2", (F.round("corr", 5) + 0.0).alias("corr"))


@query(
    PRE
    + CLOCK
    + RAW
    + BINS.format(parts=10)
    + """, cut AS (SELECT doc_id, term, bin, CASE WHEN n >= 2 THEN n ELSE 0 END AS n FROM bins),
    kept AS (SELECT * FROM cut WHERE (doc_id, term) IN (SELECT (doc_id, term) FROM cut GROUP BY doc_id, term HAVING sum(n) >= 10))"""
    + CORR.format(src="kept")
    + " SELECT doc_id, w1, w2, round(corr, 5) + 0 AS corr FROM corrs WHERE w1 < w2 AND corr > 0.5"
)
def profile_corr_thresholded(spark, d):
    corr = profiles.correlations(profiles.frequent_columns(_bins(spark, d, 10), 2, 10, "doc_id"), "doc_id")
    return corr.where((F.col("w1") < F.col("w2")) & (F.col("corr") > 0.5)).select("doc_id", "w1", "w2", (F.round("corr", 5) + 0.0).alias("corr"))


@query(PRE + CLOCK + RAW + BINS.format(parts=10) + CORR.format(src="bins") + " SELECT doc_id, w1, w2, round(corr, 5) + 0 AS corr FROM corrs WHERE w1 < w2 AND round(corr, 9) > 0.6 AND round(corr, 9) < 1")
def profile_corr_walk(spark, d):
    """The walk that strikes out terms without a strong correlation."""
    corr = profiles.correlations(_bins(spark, d, 10), "doc_id")
    return profiles.drop_uncorrelated(corr, 0.6, "doc_id").withColumn("corr", F.round("corr", 5) + 0.0)


FAMILY_BINS = """,
    members AS (SELECT DISTINCT word, regexp_replace(word, '(es|en|er|s)$', '') AS family FROM tokens WHERE len(word) >= 5),
    counted AS (SELECT t.doc_id, t.sent_id, m.family, count(*) AS x FROM tokens t JOIN members m ON m.word = t.word GROUP BY ALL),
    frequent AS (SELECT doc_id, family FROM counted GROUP BY doc_id, family HAVING sum(x) >= 4),
    setup AS (SELECT *, ceil(total / 10)::BIGINT AS width FROM ends),
    cells AS (SELECT c.doc_id, c.family, (l.t - s.t0) // s.width AS bin, sum(c.x) AS x
      FROM counted c JOIN frequent f ON f.doc_id = c.doc_id AND f.family = c.family JOIN clocked l ON l.doc_id = c.doc_id AND l.sent_id = c.sent_id JOIN setup s ON s.doc_id = c.doc_id GROUP BY ALL),
    grid AS (SELECT doc_id, unnest(range(0, (total - t0) // width + 1)) AS bin FROM setup),
    bins AS MATERIALIZED (SELECT g.doc_id, f.family AS term, g.bin, coalesce(c.x, 0)::BIGINT AS n FROM grid g JOIN frequent f ON f.doc_id = g.doc_id LEFT JOIN cells c ON c.doc_id = g.doc_id AND c.family = f.family AND c.bin = g.bin)"""


@query(PRE + CLOCK + FAMILY_BINS + CORR.format(src="bins") + " SELECT doc_id, w1, w2, round(corr, 5) + 0 AS corr FROM corrs WHERE w1 < w2 AND round(corr, 9) > 0.6 AND round(corr, 9) < 1")
def family_corr(spark, d):
    """Families of words of one stem whose profiles in a document go together."""
    clock, ends = clocked_with_ends(documents(spark, d).select("doc_id", "text"))
    counts = profiles.unit_profile(clock, lambda word: F.when(F.length(word) >= 5, F.regexp_replace(word, "(es|en|er|s)$", "")))
    corr = profiles.sparse_correlations(counts, ends, 10, least=4)
    return profiles.drop_uncorrelated(corr, 0.6, "doc_id").withColumn("corr", F.round("corr", 5) + 0.0)


@query(
    PRE
    + CLOCK
    + RAW
    + "".join(f", setup{p} AS (SELECT *, ceil(total / {p})::BIGINT AS width FROM ends)" for p in (5, 10))
    + ", allbins AS ("
    + " UNION ALL ".join(
        f"SELECT {p}::BIGINT AS parts, r.doc_id, r.term, ((r.t - s.t0) // width)::BIGINT AS bin, sum(n)::BIGINT AS n FROM raw r JOIN setup{p} s USING (doc_id) GROUP BY ALL UNION ALL "
        f"SELECT {p}, g.doc_id, w.term, g.bin::BIGINT, 0 FROM (SELECT doc_id, unnest(range(0, (total - t0) // width + 1)) AS bin FROM setup{p}) g, (SELECT DISTINCT term FROM raw) w"
        for p in (5, 10)
    )
    + """), grid AS (SELECT parts, doc_id, term, bin, sum(n)::DOUBLE AS n FROM allbins GROUP BY ALL),
    corrs AS (SELECT a.parts, a.doc_id, a.term AS w1, b.term AS w2, CASE WHEN min(a.n) < max(a.n) AND min(b.n) < max(b.n) THEN corr(a.n, b.n) END AS corr
      FROM grid a JOIN grid b ON a.parts = b.parts AND a.doc_id = b.doc_id AND a.bin = b.bin AND a.term < b.term GROUP BY ALL)
    SELECT parts, w1, w2, round(avg(corr), 5) + 0 AS mean_corr, count(*)::BIGINT AS n FROM corrs WHERE corr IS NOT NULL GROUP BY ALL"""
)
def corr_stats_by_parts(spark, d):
    rows = None
    for parts in (5, 10):
        corr = profiles.pair_statistics(profiles.correlations(_bins(spark, d, parts), "doc_id")).withColumn("parts", F.lit(parts).cast("long"))
        rows = corr if rows is None else rows.unionByName(corr)
    return rows.groupBy("parts", "w1", "w2").agg((F.round(F.avg("corr"), 5) + 0.0).alias("mean_corr"), F.count(F.lit(1)).alias("n"))


DISTANCE = """CASE WHEN least(len(w1), len(w2)) < 3 OR greatest(len(w1), len(w2)) > least(len(w1), len(w2)) + 4 OR greatest(len(w1), len(w2)) > 2 * least(len(w1), len(w2)) THEN greatest(len(w1), len(w2))::DOUBLE
      ELSE list_min(list_transform(range(0, abs(len(w1) - len(w2)) + 1), lambda i: levenshtein(CASE WHEN len(w1) <= len(w2) THEN w1 ELSE w2 END, substr(CASE WHEN len(w1) <= len(w2) THEN w2 ELSE w1 END, i + 1, least(len(w1), len(w2))))))
           / (least(8, least(len(w1), len(w2))) / 3.0::DOUBLE) END"""
FREQUENT = ", vocab AS (SELECT word FROM tokens GROUP BY word HAVING count(*) >= 100)"


def _frequent(spark, d):
    return corpus.word_counts(sents(spark, d)).where("n >= 100").select("word")


@query(PRE + FREQUENT + f", near AS (SELECT w1, w2, round({DISTANCE}, 6) AS distance FROM (SELECT a.word AS w1, b.word AS w2 FROM vocab a JOIN vocab b ON a.word < b.word AND abs(len(a.word) - len(b.word)) <= 4)) SELECT * FROM near WHERE distance <= 1")
def word_distance(spark, d):
    """Related pairs of common words; ``word_neighbours`` takes the whole vocabulary."""
    return families.related(_frequent(spark, d)).select("w1", "w2", rounded("distance"))


@query()
def word_neighbours(spark, d):
    """Each word of the whole vocabulary that has a related word: how many, and the nearest."""
    return families.neighbours(corpus.word_counts(sents(spark, d)).select("word")).withColumn("distance", F.round("distance", 6))


@query(
    PRE
    + f""", vocab AS (SELECT DISTINCT word FROM tokens),
    hits AS (SELECT DISTINCT w1 AS word FROM (SELECT v.word AS w1, s AS w2 FROM vocab v JOIN (SELECT unnest([{quoted(STOP)}]) AS s) ON abs(len(v.word) - len(s)) <= 2) WHERE {DISTANCE} < 0.7)
    SELECT word FROM vocab WHERE word NOT IN (SELECT word FROM hits)"""
)
def fuzzy_stopword_anti(spark, d):
    return families.fuzzy_stop_free(corpus.word_counts(sents(spark, d)).select("word"), words_frame(spark, STOP))


def _document_families(spark, d):
    """Families of all words of each document; whole texts are dealt by key, so their words are counted where they are."""
    counts = corpus.word_counts(corpus.sentences(rounds.dealt(documents(spark, d).select("doc_id", "text"), "doc_id")), "doc_id")
    return families.families(counts.select("doc_id", F.struct(-F.col("n"), "word").alias("ord"), "word"), "doc_id")


@query()
def word_families(spark, d):
    """Families of all words of each document, the most frequent first."""
    return _document_families(spark, d)
