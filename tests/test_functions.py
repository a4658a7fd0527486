import random
import re

from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.functions import text as tx
from lexmill.operators import articles, corpus, families, patterns, profiles, terms

# Inputs and results of small cases that are given or follow from the rules.


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sentences_and_words(spark):
    text = "One,two, Three, Четыре, пять? Я иду ИСКАТЬ! OnE,TWO, ..."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.sent_id: r.words for r in corpus.sentences(docs).collect()}
    assert rows == {0: ["one", "two", "three", "четыре", "пять"], 1: ["я", "иду", "искать"], 2: ["one", "two"]}
    assert terms.collocations(docs, 5, True).count() == 18


def test_sentence_break_needs_space(spark):
    docs = spark.createDataFrame([(1, "Мноогобещающий старт.Вдохни свежего воздуха! " * 50)], "doc_id long, text string")
    assert [tuple(r) for r in corpus.totals(corpus.sentences(docs)).collect()] == [(50, 250)]


def test_long_letter_runs_do_not_break_the_regex(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000)], "doc_id long, text string")
    assert corpus.sentences(docs).select(F.sum("n_words")).first()[0] == 1


def test_tags_and_names(spark):
    tags = spark.createDataFrame([("О!   Привет медвед",), ("database as код",), ("ООП",), ("Блог компании X",), ("a б",)], ["t"])
    assert [r.v for r in tags.select(tx.validate_tag(F.col("t")).alias("v")).collect()] == ["О Привет медвед", "код", "ООП", None, None]
    assert one(spark, tx.simplify_name(F.lit("'patt#ernS+Y"))) == "patt_ernS_Y"
    assert one(spark, tx.hex_id(F.lit("abc"))) == "90015098"
    assert one(spark, tx.positions("1", F.lit("123451234512345"))) == [0, 5, 10]
    assert one(spark, tx.join_paragraphs(F.array(F.lit("пат-"), F.lit("терн"), F.lit("-")))) == "паттерн\n-\n"
    assert one(spark, tx.cut_through(F.lit("Xx Title rest"), F.lit("title"))) == " rest"


def test_word_distance(spark):
    pairs = [("порог", "порога", 0), ("порог", "порожек", 0.6), ("порога", "порожек", 1.0), ("бег", "бежать", 1.0), ("бег", "побег", 0), ("порожек", "бег", 7), ("бежать", "побег", 3.0), ("порог", "побег", 1.2)]
    rows = spark.createDataFrame([(a, b, float(d)) for a, b, d in pairs], "a string, b string, d double")
    assert all(abs(r.v - r.d) < 1e-9 for r in rows.select("d", scores.word_distance("a", "b").alias("v")).collect())


def test_word_families(spark):
    words = ["порог", "порога", "порожек", "бег", "бежать", "побег"]
    rows = families.families(spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "group long, ord int, word string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.family, set()).add(r.word)
    assert list(found.values()) == [{"порог", "порога", "порожек"}, {"бег", "бежать", "побег"}]


def test_burstiness_matches_resampling(spark):
    lengths, counts = [5, 3, 4, 2, 6, 1, 9, 2, 30, 2], [1, 0, 2, 0, 1, 0, 3, 0, 1, 1]
    t, clock = 0, []
    for i, n in enumerate(lengths):
        t += n
        clock.append((1, i, t))
    clocked = spark.createDataFrame(clock, "doc_id long, sent_id long, t long")
    occ = spark.createDataFrame([(1, i, "x", 1) for i, c in enumerate(counts) for _ in range(c)], "doc_id long, sent_id long, term string, n_words long")
    parts = spark.createDataFrame([(1, p) for p in (2, 3, 5)], "doc_id long, parts long")
    got = {r.parts: round(r.score, 6) for r in profiles.stdev_ranks(occ, clocked, parts).collect()}
    assert got == {5: 1.788854, 3: 1.0, 2: 3.535534}


def test_pattern_variants(spark):
    rows = spark.createDataFrame([(0, "T? является Т?"), (1, "под Т понимают"), (2, "рассмотрим Т?")], "pattern_no int, pattern string")
    found = {}
    for r in patterns.extend(rows).orderBy("pattern_no", "variant").collect():
        found.setdefault(r.pattern_no, []).append(r.pattern)
    assert found == {0: ["T является", "является T", "T является T"], 1: ["под T понимают"], 2: ["рассмотрим T"]}


def test_interleave(spark):
    lists = [[1, 2, 3], [11, 22, 33, 44], [111, 222, 333, 444, 555]]
    rows = spark.createDataFrame([(n, i, v) for n, x in enumerate(lists) for i, v in enumerate(x)], "l int, i int, v int")
    assert [r.v for r in terms.interleave(rows, "l", "i", "v").collect()] == [1, 11, 111, 2, 22, 222, 3, 33, 333, 44, 444, 555]


def test_join_terms_merges_by_shared_lemmas(spark):
    rows = [
        (1, "паттерна", ["паттерна"], 3, [["паттерн"]], {"паттерн": 2.0}),
        (1, "паттерн", ["паттерн"], 2, [["паттерн"]], {"паттерн": 9.0}),
        (1, "foo", ["foo"], 5, [["foo"]], {"foo": -1.0}),
    ]
    got = terms.join_terms(spark.createDataFrame(rows, "doc_id long, term string, words array<string>, n long, lemmas array<array<string>>, scores map<string,double>")).collect()
    assert [(r.term, r.n, r.members) for r in got] == [("паттерн", 5, 2)]


def test_gaps_and_islands(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, False), (6, False), (7, True)], "number long, saved boolean")
    assert sorted((r.lo, r.hi) for r in articles.number_gaps(rows).where("hi is not null").collect()) == [(4, 5)]
    assert sorted((r.lo, r.hi) for r in articles.unsaved_islands(rows).where("hi is not null").collect()) == [(2, 3), (6, 6)]


def test_email_lines_are_trimmed_until_none_is_left(spark):
    def looped(text):
        """The two loops, one match at a time."""
        size = lambda m: (m.end() / len(text), (len(text) - m.start()) / len(text))
        while (found := list(re.finditer(tx.EMAIL_LINE, text))) and size(found[-1])[1] <= 0.2 and "@" not in text[found[-1].end() :]:
            text = text[: found[-1].start()]
        while m := re.search(tx.EMAIL_LINE, text):
            head, tail = size(m)
            text = text[m.end() :] if head <= 0.1 else text[: m.start()] if tail <= 0.2 else text[: m.start()] + text[m.end() :]
        return text

    rng = random.Random(8)
    line = lambda i: f"line {i} of the text" * 3 + "\n"
    texts = ["".join(line(i) + (f"E-mail: a{i}@b.c\n" if 12 <= i < 32 else "") for i in range(50)), "", "no such line", "E-mail: a@b.c\n"]
    # the last line is in the tail zone of the whole text, the one before it only in that of what the first cut leaves
    texts.append("".join(line(i) + ("E-mail: a@b.c\n" if i in (15, 16, 17) else "") for i in range(20)))
    texts += ["".join(rng.choice([line(i), "e-mail d@e.f\n", "my email\n", "x@y.z\n"]) for i in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in articles.trim_emails(docs).collect()}
    assert got.pop(-1) is None and got == {i: looped(t) for i, t in enumerate(texts)}
    assert "mail" not in got[0].lower() and got[0].count("\n") == 50


def test_patterns_of_any_number_of_slots(spark):
    rows = spark.createDataFrame([("T is T of T",), ("no slot",), ("T and T",)], "pattern string")
    lengths = spark.createDataFrame([(1,), (2,)], "size int")
    got = {(r.pattern, tuple(r.sizes)): (r.n_tokens, [(s.start, s.end) for s in r.spans]) for r in patterns.fill(rows, lengths).collect()}
    assert len(got) == 8 + 4 and got["T is T of T", (2, 1, 2)] == (7, [(0, 2), (3, 4), (5, 7)])
    assert patterns.fill(rows.where("pattern = 'no slot'"), lengths).count() == 0


def test_similar_articles_are_walked_to_the_end(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    found = {r.node: r.round for r in articles.similar(nodes, edges, nodes.where("node = 0"), F.lit(True), 100).collect()}
    assert found == {i: i for i in range(9)}
    assert articles.similar(nodes, edges, nodes.where("node = 0"), F.lit(True), 100, rounds=2).count() == 3


def test_bibliography_captions(spark):
    texts = ["Текст\nСписок  использованной литературы:\n1. А", "Текст\nСПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ\n1. А", "Текст\nСписок\n1. А"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(articles.cut_bibliography(F.col("t")).alias("t")).collect()]
    assert [t.strip() for t in got] == ["Текст", "Текст", texts[2]]


def test_bibliography_is_cut_at_its_line(spark, monkeypatch):
    import duckdb
    from lexmill.plans import record_queries
    from lexmill.plans.base import SQL

    texts = ["см. Список литературы ниже\n\nСписок литературы\n1. А", "Литература\n1. А", "x\n \n  References.\ny\nREFERENCES", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in frame.select(articles.cut_bibliography(F.col("t")), articles.cut_bibliography(F.col("t"), last=True)).collect()] == [
        ("см. Список литературы ниже\n\n",) * 2, ("", ""), ("x\n \n", "x\n \n  References.\ny\n"), ("", "")]
    odd = ["", "\n", "a\n\n", "a\n \t\n", "a\r", "Список литературы\nb", "b\nReferences\nc", "Тема en\nReferences", "bibliography:", None, "İ\u2028x\x85"]
    rows = [(i, t, "en", "src1") for i, t in enumerate(odd)] + [(90, "a", None, "s"), (91, "a\n", "en", None), (92, "a\n", "", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = dict(con.sql(SQL["bibliography_after_title"]).fetchall())
    monkeypatch.setattr(record_queries, "documents", lambda *_: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id: r.text for r in record_queries.bibliography_after_title(spark, "").collect()} == want
