"""Steps whose work or disk grew faster than the input."""

import random

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import articles, corpus, lemma_index, patterns, profiles, rounds, terms


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_sentence_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "One two. Three.\n\n Four five.Six! ... Seven")], "doc_id long, text string")
    found = corpus.sentences(docs)
    assert [(r.sent_id, r.words) for r in found.orderBy("sent_id").collect()] == [(0, ["one", "two"]), (1, ["three"]), (2, ["four", "five", "six"]), (3, ["seven"])]
    assert plan(corpus.word_counts(found)).count("regexp_extract_all(") == 1


def test_settled_steps_are_files_that_can_be_deleted(spark):
    df = rounds.settled(spark.range(5).withColumn("m", F.create_map(F.lit("a"), F.col("id"))))
    assert "FileScan parquet" in executed(df) and df.count() == 5
    rounds.discard(df)


def test_burstiness_bins_only_frequent_terms_and_equals_the_dense_profile(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]
        t += len(words)
        rows.append((1, i, words, len(words), t))
    clock = spark.createDataFrame(rows, "doc_id long, sent_id long, words array<string>, n_words long, t long")
    occ = clock.select("doc_id", "sent_id", "t", F.explode("words").alias("term")).withColumn("n_words", F.lit(1).cast("long"))
    ends = profiles.ends_of(clock.drop("t"), "doc_id")
    assert ends.collect() == profiles.clock_ends(clock, "doc_id").collect()
    ways = spark.createDataFrame([(1, 4), (1, 9)], "doc_id long, parts long")
    found = {(r.term, r.parts): r for r in profiles.stdev_ranks(occ, clock, ways, least=20, ends=ends).collect()}
    counts = {r.term: r["count"] for r in occ.groupBy("term").count().collect()}
    assert {k[0] for k in found} == {x for x, n in counts.items() if n >= 20}
    for parts in (4, 9):
        dense = profiles.compressed(occ.groupBy("doc_id", "term", "t").agg(F.count(F.lit(1)).alias("n")), ends, parts)
        for r in dense.groupBy("term").agg(F.stddev_samp("n").alias("sd"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins")).collect():
            if r.n >= 20:
                x = found[r.term, parts]
                assert (x.n, x.bins) == (r.n, r.bins) and abs(x.score - r.sd) < 1e-9


def test_few_patterns_meet_sentences_without_a_shuffle(spark):
    sents = spark.createDataFrame([(1, 0, ["x", "is", "the", "y", "z"], 5)], "doc_id long, sent_id long, words array<string>, n_words long")
    filled = patterns.fill(spark.createDataFrame([("T is the T",)], "pattern string"), spark.createDataFrame([(1,), (2,)], "size int"))
    found = patterns.matches(sents, filled)
    assert sorted((r.slot_no, r.phrase) for r in found.collect()) == [(0, "x"), (0, "x"), (1, "y"), (1, "y z")]
    assert "SortMergeJoin" not in executed(found)


def test_only_lemmas_of_literals_are_indexed(spark):
    sents = spark.createDataFrame([(1, 0, ["walked", "walks", "cats", "new"], 4)], "doc_id long, sent_id long, words array<string>, n_words long")
    morph = spark.createDataFrame([("walked", "walk"), ("walks", "walk"), ("walks", "walks"), ("cats", "cat")], "word string, lemma string")
    only = spark.createDataFrame([("walk",), ("new",)], "lemma string")
    whole = {(r.lemma, tuple(r["at"])) for r in lemma_index.build(sents, morph).collect()}
    part = {(r.lemma, tuple(r["at"])) for r in lemma_index.build(sents, morph, only=only).collect()}
    assert part == {x for x in whole if x[0] in ("walk", "new")} == {("walk", (0, 1)), ("new", (3,))}


def test_links_of_authors_are_classes(spark):
    rows = [(1, "t", ["a", " b "]), (2, "t", ["a"]), (3, "t", ["b"]), (4, "u", ["a"]), (5, None, ["a"]), (6, "t", None), (2, "t", ["a"])]
    found = articles.author_edges(spark.createDataFrame(rows, "node long, topic string, authors array<string>"))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(1, "t", "a", 1, 1), (1, "t", "b", 1, 1), (2, "t", "a", 1, 1), (3, "t", "b", 1, 1), (4, "u", "a", 4, 0), (5, None, "a", 5, 0), (6, "t", None, 6, 0)], key=str)


def test_edges_of_authors_are_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["t", "u", None]), [rng.choice([" a", "b ", "c", None]) for _ in range(rng.randrange(4))]) for i in range(60)] + [(60, "t", None), (0, "t", ["a"])]
    sides = [(n, {(t, x.strip()) for x in a or [] if x and t}) for n, t, a in rows]
    want = sorted({(m, n) for m, a in sides for n, b in sides if m != n and a & b})
    frame = spark.createDataFrame(rows, "node long, topic string, authors array<string>")
    for size in (1 << 12, 5):  # one block a class, and several that meet in tasks of their own
        monkeypatch.setattr(articles, "MEMBERS", size)
        found = articles.author_pairs(frame)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    held = spark.createDataFrame([(i, "en", "x") for i in range(50)], "doc_id long, lang string, source string")
    pairs = articles.author_pairs(held.select(F.col("doc_id").alias("node"), F.col("lang").alias("topic"), F.array("source").alias("authors")))
    assert pairs.columns == ["src", "dst"] and pairs.count() == 50 * 49


def test_grams_filter_their_words_once_and_sets_are_dealt_as_articles(spark):
    df = spark.createDataFrame([(["aa", "b", "cc", "dd"],)], "w array<string>").select(tx.ngrams(F.col("w"), 3).alias("g"))
    assert df.first().g == ["aa", "cc", "dd", "aa cc", "cc dd", "aa cc dd"]
    assert plan(spark.range(1).select(tx.ngrams(F.split(F.col("id").cast("string"), " "), 3).alias("g"))).count("filter(") == 1
    arts = spark.createDataFrame([(1, "One two", "Three four. Five", ["k", "k"])], "doc_id long, title string, abstract string, keywords array<string>")
    sets = terms.test_sets(arts)
    assert executed(sets).count("Exchange") == 1 and sets.where("kind = 'keywords'").count() == 1


def test_near_words_of_a_text_are_those_of_all_pairs(spark):
    from lexmill.functions import scores
    from lexmill.operators import families
    from test_greedy import some_words

    for seed in (4, 5):
        words = sorted(set(some_words(seed)) | {"наблюдение", "наблюдению", "наблюдатель", "ёж", "abcdefgh", "xabcdefg", "bcdefgha", "abcdefghabcd"}, key=len)
        got = {(*sorted((words[a], words[b])), round(d, 9)) for a, b, d in zip(*(x.tolist() for x in families.near_words(words)))}
        a, b = (spark.createDataFrame([(w,) for w in words], f"w{i} string") for i in (1, 2))
        every = a.crossJoin(b).where("w1 < w2").withColumn("d", scores.word_distance("w1", "w2")).where("d <= 1")
        assert got == {(r.w1, r.w2, round(r.d, 9)) for r in every.collect()} and got
    rows = spark.createDataFrame([(1, 1, "порог"), (1, 2, "порога")], "group long, ord long, word string")
    assert "Generate" not in plan(families.families(rows))


def test_neighbours_are_counted_in_blocks_without_rows_of_pairs(spark, monkeypatch):
    from lexmill.functions import scores
    from lexmill.operators import families
    from test_greedy import some_words

    rng, letters = random.Random(6), [chr(0x430 + i) for i in range(32)] + list("abcdefghijklmnopqrstuvwxyz-")
    words = set(some_words(6)[:70]) | {"abcdefgh", "xabcdefg", "bcdefgha", "abcdefghabcd"}
    for n in (9, 11, 14, 17, 23):  # letters that fit 64 bits, and not; masks and pieces
        for w in ("".join(rng.choices(x, k=n)) for x in ("ab", letters)):
            at = rng.randrange(n - 1)
            words |= {w, w[:at] + "q" + w[at + 1 :], "z" + w[:at] + w[at + 1 :] + "ab", w[1:] + "q", w[:at] + w[at + 1] + w[at] + w[at + 2 :]}
    frame = spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
    every = frame.crossJoin(frame.withColumnRenamed("word", "other")).where("word <> other").withColumn("d", scores.word_distance("word", "other")).where("d <= 1")
    expected = {(r.word, r.n, round(r.x.d, 9), r.x.other) for r in every.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "other")).alias("x")).collect()}
    for size, pairs in ((1 << 17, 1 << 22), (30, 50)):  # one block a length, and several that are worked off in parts
        monkeypatch.setattr(families, "WORDS", size)
        monkeypatch.setattr(families, "PAIRS", pairs)
        found = families.neighbours(frame)
        assert {(r.word, r.n_related, round(r.distance, 9), r.nearest) for r in found.collect()} == expected and expected
        assert "levenshtein" not in plan(found)


def test_titles_with_references_cut_short_are_those_of_the_sql(spark):
    import duckdb
    from lexmill.operators import html
    from lexmill.plans import catalogue

    titles = ["a &amp; b", "cut&amp", "x &lt y&gt", "&amp;lt;", "&amplt;", "&nbsp;edge\n&nbsp", "&quot;q&quot", "", " plain "]
    rows = [(i, f"<html><title>{t}</title><p>&amp</p>") for i, t in enumerate(titles)] + [(99, "<p>none</p>")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = dict(con.sql(catalogue.SQL["html_title"]).fetchall())
    found = html.parse(spark.createDataFrame(rows, "page_id long, html string")).select("page_id", F.trim("title").alias("title"))
    assert {r.page_id: r.title for r in found.collect()} == want and want[1] == "cut&" and want[5] == "edge"


def test_candidates_are_made_without_lambdas(spark):
    rng = random.Random(5)
    stop = ["the", "of"]
    lines = [(d, i, [rng.choice(["the", "of", "ab", "cat", "dog", "ёжик", "a-b"]) for _ in range(rng.randrange(1, 9))]) for d in range(4) for i in range(6)]
    want = []
    for d, i, w in lines:
        good = [len(x) >= 3 and x not in stop for x in w]
        want += [(d, i, p, " ".join(w[p : p + n]), n) for p in range(len(w)) for n in (1, 2, 3) if p + n <= len(w) and all(good[p : p + n])]
    sents = spark.createDataFrame(lines, "doc_id long, sent_id long, words array<string>")
    found = terms.candidates(sents, stop, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want) and "lambda" not in plan(found)


def some_books(spark, path):
    """Documents of two sources and of none, one of them without words; gives the sentences by (source, doc_id)."""
    rng = random.Random(6)
    held = {(s, d): [[rng.choice("alpha beta gamma delta kappa".split()) for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(3, 30))] for d, s in enumerate(["x", "y", "x", None, "x", "y"])}
    rows = [(d, s, ". ".join(" ".join(w).capitalize() for w in lines) + ".") for (s, d), lines in held.items()] + [(9, "y", "?")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{path}/documents.parquet")
    return held


def test_each_task_keeps_the_first_terms_of_a_source(spark, tmp_path):
    from collections import Counter

    from lexmill.plans import evaluation_queries

    held, n, df = some_books(spark, str(tmp_path)), {}, {}
    for (s, _), lines in held.items():
        own = Counter(" ".join(w[p : p + k]) for w in lines for k in (1, 2) for p in range(len(w) - k + 1))
        n.setdefault(s, Counter()).update(own)
        df.setdefault(s, Counter()).update(set(own))
    want = {(s, alg, t, i + 1) for alg, counts in (("freq", n), ("df", df)) for s, c in counts.items() for i, t in enumerate(sorted(c, key=lambda t: (-c[t], t))[: evaluation_queries.TOP])}
    found = evaluation_queries._ranked(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == want
    # texts, then sums of terms, then the first terms of each task: no other shuffle
    shown = executed(found).split("Initial Plan")[-1]
    assert shown.count("Exchange hashpartitioning") == 3 and shown.count("WindowGroupLimit") == 2


def test_burstiness_of_books_shuffles_texts_and_sums_only(spark, tmp_path):
    import statistics
    from collections import Counter

    from lexmill.plans import ranking_queries

    held = some_books(spark, str(tmp_path))
    found = ranking_queries._book_ranks(spark, str(tmp_path), 7)
    want = {}
    for book in {s for s, _ in held}:
        own = [lines for (s, _), lines in held.items() if s == book]
        cells, bins = {}, 0
        for d, lines in enumerate(own):
            parts = max(1, round(7 * len(lines) / sum(map(len, own))))
            total, t = sum(map(len, lines)), 0
            width, t0 = -(-total // parts), len(lines[0])
            bins += (total - t0) // width + 1
            for w in lines:
                t += len(w)
                for k in (1, 2):
                    for p in range(len(w) - k + 1):
                        cells.setdefault((" ".join(w[p : p + k]), k), Counter())[d, (t - t0) // width] += 1
        for (term, k), c in cells.items():
            if sum(c.values()) >= 3:
                x = [*c.values(), *[0] * (bins - len(c))]
                want[book, term] = (sum(x), statistics.stdev(x) * k)
    rows = {(r.book, r.term): (r.n, r.score) for r in found.collect()}
    assert rows.keys() == want.keys() and all(n == want[x][0] and abs(score - want[x][1]) < 2e-6 for x, (n, score) in rows.items())
    at_terms = executed(found).split("Initial Plan")[-1].split("posexplode(words")[0]
    assert at_terms.count("Exchange hashpartitioning") == 1


def test_texts_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 10) for i in range(40)] + [(40, None)], "doc_id long, text string")
    assert rounds.dealt(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(rounds, "DEALT", 100)
    assert rounds.dealt(docs, "doc_id").rdd.getNumPartitions() == 20 and rounds.dealt(docs, "doc_id").count() == 41
    assert rounds.dealt(docs.where("text is null"), "doc_id").count() == 1


def test_near_words_of_several_texts_are_found_by_bits(spark, monkeypatch):
    import numpy as np
    from lexmill.operators import families
    from test_greedy import some_words

    rng = random.Random(11)
    words = set(some_words(7)) | {"x" * 24 + y for y in ("", "a", "ab", "ba", "abcde")} | {"x" * 30, "y" + "x" * 30, "漢" * 9, "漢" * 8 + "字"}
    words = sorted(words, key=len)
    sizes = np.array([len(w) for w in words])
    # all pairs, compared letter by letter
    want = set()
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            n = len(a)
            if (n == 1 and len(words[j]) == 1) or (n >= 3 and len(words[j]) <= min(n + 4, 2 * n)):
                x, y, d = families._compared(words, sizes, np.array([i]), np.array([j]), n, 1 if n <= 5 else 2) if n > 1 else ([i], [j], [1.0])
                want |= {(int(p), int(q), round(float(r), 9)) for p, q, r in zip(x, y, d)}
    for columns, cells in ((1 << 15, 1 << 15), (64, 2)):  # all at once, and in blocks
        monkeypatch.setattr(families, "COLUMNS", columns)
        monkeypatch.setattr(families, "CELLS", cells)
        a, b, d = families.near_words(words)
        assert {(int(p), int(q), round(float(r), 9)) for p, q, r in zip(a, b, d)} == want and len(a) == len(want) > 50
    texts = {g: rng.sample(words, 40) for g in range(30)}
    rows = spark.createDataFrame([(g, i, w) for g, t in texts.items() for i, w in enumerate(t)], "group long, ord int, word string")
    found = []
    for together in (1, 200, 1 << 12):  # a text at a time, and several
        monkeypatch.setattr(families, "TOGETHER", together)
        found.append(sorted(map(tuple, families.families(rows).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 1200
    assert "FlatMapGroups" not in executed(families.families(rows))


def some_sentences(spark, seed, words="walked walks cats new cat walk ab".split()):
    rng = random.Random(seed)
    rows = [(d, i, [rng.choice(words) for _ in range(rng.randrange(1, 9))]) for d in range(5) for i in range(8)]
    return spark.createDataFrame([(d, i, w, len(w)) for d, i, w in rows], "doc_id long, sent_id long, words array<string>, n_words long")


def stems(word):
    return F.array_distinct(F.array(word, F.regexp_replace(word, "(ed|s)$", ""), F.when(word == "new", "novel").otherwise(word)))


def test_pairs_of_words_meet_terms_by_both_lemmas(spark, monkeypatch):
    sents = some_sentences(spark, 12)
    morph = sents.select(F.explode("words").alias("word")).distinct().select("word", F.explode(stems(F.col("word"))).alias("lemma"))
    held = [("walks cat", ["walks", "cat"]), ("new cats", ["new", "cats"]), ("cat cat", ["cat", "cat"]), ("dogs bark", ["dogs", "bark"])]
    wanted = spark.createDataFrame(held, "term_id string, words array<string>")
    every = wanted.withColumn("lemmas", F.transform("words", stems))
    want = sorted(map(tuple, terms.phrase_occurrences(corpus.tokens(sents), every, morph=morph).select("doc_id", "sent_id", "term_id", "start").collect()))
    # terms that are broadcast, and shuffled after pairs were filtered by a table of many bits and of few
    for small, most, slots in ((F.broadcast, 50_000, 1), (lambda df: df.hint("merge"), 1, 1 << 18), (lambda df: df.hint("merge"), 1, 1)):
        monkeypatch.setattr(rounds, "small", small)
        monkeypatch.setattr(rounds, "BROADCAST_ROWS", most)
        monkeypatch.setattr(terms, "SLOTS", slots)
        found = terms.pair_occurrences(sents, wanted, stems)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 30


def test_extraction_looks_up_words_of_kept_candidates_only(spark):
    sents = some_sentences(spark, 14)
    asked = []

    def morph(words):
        asked.append({r.word for r in words.distinct().collect()})
        return words.distinct().select("word", F.col("word").alias("lemma"), *[F.lit(x).alias(c) for c, x in zip(("pos", "number", "animacy", "gcase"), ("NOUN", "sing", "inan", "nomn"))], F.array(F.lit("Sgtm")).alias("flags"))

    stop = spark.createDataFrame([("new",)], "word string")
    every = morph(sents.select(F.explode("words").alias("word")))
    found = terms.extract(sents, ["ab"], stop, morph, 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, terms.extract(sents, ["ab"], stop, every, 1).collect())) and found.count()
    assert "ab" in asked[0] and "ab" not in asked[1]


def test_document_frequency_of_books_shuffles_texts_and_counts_only(spark, tmp_path):
    from collections import Counter

    from lexmill.plans import ranking_queries

    want = Counter()
    for (s, d), lines in some_books(spark, str(tmp_path)).items():
        want.update({(s, " ".join(w[p : p + k])) for w in lines for k in (1, 2) for p in range(len(w) - k + 1)})
    found = ranking_queries.book_document_frequency(spark, str(tmp_path))
    assert {(r.book, r.term): r.df for r in found.collect()} == want
    assert "lexmill/step" not in executed(found) and executed(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_dealt_sentences_are_indexed_where_they_are(spark):
    sents = some_sentences(spark, 13)
    morph = sents.select(F.explode("words").alias("word")).distinct().select("word", F.explode(stems(F.col("word"))).alias("lemma"))
    only = spark.createDataFrame([("walk",), ("novel",)], "lemma string")
    rows = lambda df: sorted((r.lemma, r.doc_id, r.sent_id, r["at"]) for r in df.collect())
    found = lemma_index.build(sents.repartition(3, "doc_id"), stems)
    assert rows(found) == rows(lemma_index.build(sents, morph)) and executed(found).split("Initial Plan")[-1].count("Exchange") == 1
    assert rows(lemma_index.build(sents, stems, only=only)) == rows(lemma_index.build(sents, morph, only=only))


def test_sparse_correlations_are_those_of_all_cells(spark):
    rng = random.Random(15)
    rows, at = [], {}
    for d in range(4):
        for i in range(30):
            w = [rng.choice("abcde") for _ in range(rng.randrange(1, 9))]
            at[d] = at.get(d, 0) + len(w)
            rows.append((d, i, w, len(w), at[d]))
    clock = spark.createDataFrame(rows, "doc_id long, sent_id long, words array<string>, n_words long, t long").where("doc_id < 3 or sent_id < 1")
    own = lambda w: F.when(w != "e", F.when(w == "b", "a").otherwise(w))
    members = clock.select(F.explode("words").alias("word")).distinct().select("word", own(F.col("word")).alias("term")).where("term is not null")
    counts, ends = profiles.unit_profile(clock, own), profiles.clock_ends(clock, "doc_id")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, profiles.unit_profile(clock, members).select("doc_id", "term", "t", "n").collect()))
    kept = counts.join(counts.groupBy("doc_id", "term").agg(F.sum("n").alias("all")).where("all >= 4"), ["doc_id", "term"], "left_semi")
    rounded = lambda df: sorted((r.doc_id, r.w1, r.w2, None if r["corr"] is None else round(r["corr"], 9)) for r in df.collect())
    assert rounded(profiles.sparse_correlations(counts, ends, 10, least=4)) == rounded(profiles.correlations(profiles.compressed(kept, ends, 10), "doc_id"))


def test_noun_groups_of_dealt_sentences_need_no_join(spark):
    from lexmill.operators import groups
    from lexmill.plans import group_queries

    sents = some_sentences(spark, 16, "the red dogs and new cats sit on hat held".split()).withColumn("t", F.col("sent_id") * 3)
    found = groups.noun_groups(sents.repartition(3, "doc_id"), group_queries._tag, nested=True, carry=("t",))
    want = groups.noun_groups(sents, group_queries._tags(sents), nested=True, carry=("t",))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 30
    assert executed(found).split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan(found)


def test_items_of_an_article_are_made_distinct_in_an_array(spark):
    rows = [(1, "One two", "Three four. Five", ["k", "k"]), (2, None, "", None), (3, "Aa", "Bb aa bb", [None, "z"]), (1, "One two", None, ["m"])]
    arts = spark.createDataFrame(rows, "doc_id long, title string, abstract string, keywords array<string>")
    found = terms.item_sets(arts)
    assert {(r.doc_id, r.kind): sorted(r["items"], key=str) for r in found.collect()} == {
        (1, "title"): ["one", "one two", "two"], (1, "abstract"): ["five", "four", "three", "three four"], (1, "keywords"): ["k", "m"],
        (3, "title"): ["aa"], (3, "abstract"): ["aa", "aa bb", "bb", "bb aa", "bb aa bb"], (3, "keywords"): [None, "z"]}
    assert "SortAggregate" not in executed(found) and terms.test_sets(arts).count() == 17
    df = spark.createDataFrame([(["aa", "bb"],), ([],)], "w array<string>")
    assert [r.g for r in df.select(tx.ngrams(F.col("w"), 4).alias("g")).collect()] == [["aa", "bb", "aa bb"], []]
    assert df.select(tx.ngrams(F.col("w"), 1).alias("g")).first().g == ["aa", "bb"]
