"""Lemma matching and the whole extraction on small hand-made cases."""

from pyspark.sql import functions as F

from lexmill.operators import evaluation, lemmas, terms

MORPH = [("cats", "cat"), ("cat", "cat"), ("dogs", "dog"), ("dog", "dog"), ("saw", "see"), ("saw", "saw")]


def morph(spark):
    return spark.createDataFrame(MORPH, "word string, lemma string")


def test_lemma_patterns_and_pairs(spark):
    a = spark.createDataFrame([("cats saw",), ("dog",), ("owl saw",), ("",)], "phrase string")
    patterns = {r.phrase: r.lemmas for r in lemmas.lemma_patterns(a, morph(spark)).collect()}
    assert patterns == {"cats saw": [["cat"], ["saw", "see"]], "dog": [["dog"]], "owl saw": [["owl"], ["saw", "see"]]}
    b = spark.createDataFrame([("cat see",), ("dogs",), ("owl",)], "term string")
    assert sorted(map(tuple, lemmas.same_lemmas(a, b, morph(spark)).collect())) == [("cats saw", "cat see"), ("dog", "dogs")]


def test_relevance_by_lemma(spark):
    ranked = spark.createDataFrame([(1, "cats saw dogs"), (2, "owl"), (3, "dog")], "rank int, term string")
    tests = spark.createDataFrame([("big cat see",), ("cat saw dog",), ("dogs run",)], "item string")
    found = {r.term: r.relevance for r in evaluation.relevance(ranked, tests, morph=morph(spark)).collect()}
    assert found == {"cats saw dogs": 1.0, "owl": 0.0, "dog": 0.5}


def test_extraction(spark):
    sents = spark.createDataFrame([(1, 0, "cats cats dogs the cat saw see".split())], "doc_id int, sent_id long, words array<string>")
    tags = morph(spark).select("*", F.lit("NOUN").alias("pos"), F.lit("sing").alias("number"), F.lit("inan").alias("animacy"), F.lit("nomn").alias("gcase"), F.array(F.lit("x")).alias("flags"))
    stop = spark.createDataFrame([("see",), ("dog",)], "word string")
    found = terms.extract(sents, ["the"], stop, tags, 3).select("term", "n", "members", "rank").collect()
    # "saw" and "dogs" go by their lemmas, "see" as a word; cat and cats are one term
    assert [tuple(r) for r in found] == [("cats", 3, 2, 1), ("cats cats", 1, 1, 2)]
    whole = terms.extract(sents, ["the"], stop, tags)
    assert {r.term for r in whole.collect()} == {"cats", "cats cats"}


def test_valid_and_named(spark):
    rows = spark.createDataFrame([("a-T", "E", 60, 1), ("b", "E", 59, 1), ("c", "E", 70, 0), ("d", "F", 70, 3)], "alg string, expert string, n_ranked int, n_items int")
    assert [r.alg for r in evaluation.valid(rows, "E").collect()] == ["a-T"]
    assert [r.alg for r in evaluation.named(rows, "-T").collect()] == ["a-T"]
    assert [r.alg for r in evaluation.named(rows, "-T", without=True).collect()] == ["b", "c", "d"]
