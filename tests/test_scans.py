"""Scans over long keys, range bins, the walk over authors, tiled correlations, the lemma index and noun groups against plain models."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import articles, families, groups, lemma_index, patterns, profiles, scans


def numbers(spark, rng, n, keys=(None,)):
    rows = [(k, v, rng.random() < 0.4) for k in keys for v in rng.sample(range(3 * n), n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, number long, saved boolean").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_running_sums_are_those_of_a_window(spark, seed):
    rows = numbers(spark, random.Random(seed), 200, (None, "a", "b"))
    order = W.partitionBy("k").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("s", F.sum("number").over(order)).collect()
    got = scans.running(rows, ["k"], ["number"], s="number").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = scans.running(rows.where("k = 'a'"), [], ["number"], s="number").orderBy("number").collect()
    assert [r.s for r in whole] == list(np.cumsum([r.number for r in whole]))


@pytest.mark.parametrize("seed", range(3))
def test_gaps_and_islands(spark, seed):
    rng = random.Random(seed)
    rows = numbers(spark, rng, rng.choice([3, 40, 150]), (None, "x"))
    held = {}
    for r in rows.collect():
        held.setdefault(r.k, {})[r.number] = r.saved
    gaps, runs = set(), set()
    for k, found in held.items():
        at = sorted(found)
        gaps |= {(k, a + 1, b - 1) for a, b in zip(at, at[1:]) if b - a > 1} | {(k, at[-1] + 1, None)}
        run = []
        for v in [*at, None]:
            if run and (v is None or v != run[-1] + 1 or found[v]):
                runs.add((k, run[0], run[-1]))
                run = []
            if v is not None and not found[v]:
                run.append(v)
        runs.add((k, at[-1] + 1, None))
    assert {(r.k, r.lo, r.hi) for r in articles.number_gaps(rows.unionByName(rows), "k").collect()} == gaps
    assert {(r.k, r.lo, r.hi) for r in articles.unsaved_islands(rows, "k").collect()} == runs
    one = rows.where("k = 'x'").drop("k")
    assert {(r.lo, r.hi) for r in articles.number_gaps(one).collect()} == {g[1:] for g in gaps if g[0] == "x"}
    assert {(r.lo, r.hi) for r in articles.unsaved_islands(one).collect()} == {g[1:] for g in runs if g[0] == "x"}
    assert articles.number_gaps(one.limit(0)).collect() == [] and articles.unsaved_islands(one.limit(0)).collect() == []


def test_no_window_over_all_numbers(spark):
    text = articles.number_gaps(numbers(spark, random.Random(1), 50).drop("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text and text.count("lag(number") == 1 and "_range" in text


@pytest.mark.parametrize("seed", range(4))
def test_rows_in_many_ranges(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(articles, "BINS", rng.choice([1, 7, 1000]))
    rows = spark.createDataFrame([(v,) for v in [-5, 0, 0] + [rng.randrange(-50, 900) for _ in range(200)]], "number long")
    ranges = [(a, rng.choice([a + rng.randrange(-2, 30), a])) for a in rng.choices(range(-100, 1000), k=30)] + ([(880, None)] if seed % 2 else [])
    got = sorted(r.number for r in articles.in_ranges(rows, spark.createDataFrame(ranges, "lo long, hi long")).collect())
    assert got == sorted(r.number for r in rows.collect() if any(lo <= r.number and (hi is None or r.number <= hi) for lo, hi in ranges))
    found = sorted((r.lo, r.hi) for r in scans.merged(spark.createDataFrame(ranges, "lo long, hi long")).collect())
    assert all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))
    plan = articles.in_ranges(rows, spark.createDataFrame(ranges, "lo long, hi long"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_articles_through_authors(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("tu"), [rng.choice(["a", " b", "c ", "d", "e", "f", "g"]) for _ in range(rng.randrange(0, 3))]) for i in range(60)]
    ok = {i for i, *_ in rows if i % 4}
    seed = next(i for i, _, authors in rows if len(authors) == 2)
    found, frontier, depth = {seed: 0}, {seed}, 0
    names = {i: {(t, a.strip()) for a in authors} for i, t, authors in rows}
    while frontier:
        depth += 1
        frontier = {j for j in ok - set(found) if any(names[i] & names[j] for i in frontier)}
        found |= dict.fromkeys(frontier, depth)
    frame = spark.createDataFrame(rows, "node long, topic string, authors array<string>")
    seeds = spark.createDataFrame([(seed,), (seed,)], "node long")
    assert {r.node: r.round for r in articles.similar_by_authors(frame, seeds, F.col("node") % 4 != 0, 10**6).collect()} == found
    few = articles.similar_by_authors(frame, seeds, F.col("node") % 4 != 0, 2).collect()
    assert 2 <= len(few) and max(r["round"] for r in few) <= min(x for x in set(found.values()) if sum(v <= x for v in found.values()) >= 2)


@pytest.mark.parametrize("tile", [3, 128])
def test_tiled_correlations(spark, monkeypatch, tile):
    monkeypatch.setattr(profiles, "TILE", tile)
    rng = np.random.default_rng(1)
    tables = {k: pd.DataFrame(rng.poisson(0.7, (12, n)), columns=[f"t{i:02d}" for i in range(n)]) for k, n in ((1, 8), (2, 1), (3, 5))}
    tables[3]["t03"] = 0
    tables[3]["t04"] = tables[3]["t01"] * 2
    rows = [(k, b, t, int(v)) for k, df in tables.items() for t in df for b, v in enumerate(df[t])]
    bins = spark.createDataFrame(rows, "k long, bin long, term string, n long").repartition(5)
    corr = profiles.correlations(bins, "k")
    got = {(r.k, r.w1, r.w2): r["corr"] for r in corr.collect()}
    assert len(got) == sum(len(df.columns) ** 2 for df in tables.values())
    for k, df in tables.items():
        want = df.corr()
        for a in df:
            for b in df:
                v = got[k, a, b]
                assert (v is None and np.isnan(want.at[a, b])) or abs(v - want.at[a, b]) < 1e-9
    sums = {(r.w1, r.w2): r.xy for r in profiles.cross_sums(bins.where("k = 1").drop("k")).collect()}
    assert all(sums[a, b] == float((tables[1][a] * tables[1][b]).sum()) for a in tables[1] for b in tables[1])


def test_striking_out_in_any_order_leaves_the_strong_pairs(spark):
    rng = np.random.default_rng(5)
    for trial in range(4):
        n = 9
        m = np.round(rng.uniform(-1, 1, (n, n)), 2)
        m = (m + m.T) / 2
        np.fill_diagonal(m, 1.0)
        m[0, 1] = m[1, 0] = 1.0
        names = [f"w{i}" for i in range(n)]
        walk = pd.DataFrame(m, names, names)
        walk = walk[walk < 1]
        for w in list(walk.columns):
            if walk[w].max() < 0.3:
                walk = walk.drop(columns=w, index=w)
        left = {(a, b) for a in walk for b in walk if a < b and walk.at[a, b] > 0.3}
        rows = spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "w1 string, w2 string, corr double")
        assert {(r.w1, r.w2) for r in profiles.drop_uncorrelated(rows, 0.3).collect()} == left


def test_families_as_columns_of_a_profile(spark):
    sents = spark.createDataFrame([(1, 0, ["порог", "бег", "порога"], 3), (1, 1, ["порожек", "x"], 5)], "doc_id long, sent_id long, words array<string>, t long")
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(["порог", "порога", "порожек", "бег"])], "group long, ord int, word string")
    found = families.families(words).select(F.col("group").alias("doc_id"), "word", F.concat(F.lit("f"), "family").alias("term"))
    assert sorted((r.term, r.t, r.n) for r in profiles.unit_profile(sents, found).collect()) == [("f0", 3, 2), ("f0", 5, 1), ("f1", 3, 1)]


def sentences(spark, rng, n, vocabulary):
    return spark.createDataFrame([(i % 5, i, w, len(w)) for i in range(n) for w in [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))]]], "doc_id long, sent_id long, words array<string>, n_words long")


@pytest.mark.parametrize("seed", range(2))
def test_patterns_by_lemma_through_the_index(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "as", "b", "bs", "c", "x"]
    lemmas = {"a": ["a", "q"], "as": ["a"], "b": ["b"], "bs": ["b", "q"]}
    morph = spark.createDataFrame([(w, x) for w, ls in lemmas.items() for x in ls], "word string, lemma string")
    of = lambda w: set(lemmas.get(w, [w]))
    sents = sentences(spark, rng, 60, vocabulary)
    given = ["as T b", "T bs", "a b T? c", "T T", "zz T", "a a T"]
    filled = patterns.fill(patterns.extend(spark.createDataFrame(list(enumerate(given)), "pattern_no long, pattern string")).select("pattern").distinct(), spark.createDataFrame([(1,), (2,)], "size int"))
    want = []
    for f in patterns.laid_out(filled).collect():
        if all(x is None for x in f.flat):
            continue
        for s in sents.collect():
            for p in range(len(s.words) - len(f.flat) + 1):
                here = s.words[p : p + len(f.flat)]
                if all(x is None or of(x) & of(w) for x, w in zip(f.flat, here)):
                    want += [(s.doc_id, s.sent_id, p, f.pattern, i, " ".join(here[x.start : x.end]), " ".join(here)) for i, x in enumerate(f.spans)]
    assert want and sorted(map(tuple, lemma_index.matches(sents, filled, morph).collect())) == sorted(want)


def test_a_stored_index_is_not_shuffled_by_lemma(spark, tmp_path):
    sents = sentences(spark, random.Random(3), 40, ["a", "as", "b"])
    morph = spark.createDataFrame([("as", "a")], "word string, lemma string")
    built = lemma_index.build(sents, morph)
    lemma_index.write(built, "stored_index", 4, str(tmp_path / "index"))
    stored = lemma_index.read(spark, "stored_index")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, built.collect()))
    places = stored.groupBy("lemma").agg(F.sum(F.size("at")).alias("n"))
    assert "Exchange" not in places._jdf.queryExecution().executedPlan().toString()
    assert stored.select("lemma", F.input_file_name().alias("file")).distinct().groupBy("lemma").count().where("count > 1").isEmpty()
    filled = patterns.fill(spark.createDataFrame([("a T b",)], "pattern string"), spark.createDataFrame([(1,)], "size int"))
    assert sorted(map(tuple, lemma_index.matches(sents, filled, morph, index=stored).collect())) == sorted(map(tuple, lemma_index.matches(sents, filled, morph).collect()))
    spark.sql("drop table stored_index")


# noun groups: n nominative noun, g genitive noun; N/G modifiers of either; p: plural
TAGS = {"n": ("NOUN", "nomn", "sing"), "g": ("NOUN", "gent", "sing"), "N": ("ADJF", "nomn", "sing"), "G": ("PRTF", "gent", "sing"), "gp": ("NOUN", "gent", "plur"), "Gp": ("ADJF", "gent", "plur"), "v": ("VERB", None, None)}


@pytest.mark.parametrize(
    "line,found",
    [
        ("N n", ["N n"]), ("N N n g", ["N N n g"]), ("n G g", ["n G g"]), ("n G G g gp v n", ["n G G g gp", "n"]), ("n n", ["n", "n"]), ("N g", ["g"]), ("n Gp g", ["n", "g"]), ("n Gp gp", ["n Gp gp"]),
        ("n G Gp gp", ["n", "Gp gp"]), ("G G", []), ("v", []), ("n ? g", ["n", "g"]), ("N v n", ["n"]), ("G g G g", ["G g G g"]), ("n G N n", ["n", "N n"]),
    ],
)
def test_noun_groups(spark, line, found):
    morph = spark.createDataFrame([(w, w, *t, 0.9) for w, t in TAGS.items()] + [(w, w, "NOUN", "nomn", "sing", 0.1) for w in TAGS], "word string, lemma string, pos string, gcase string, number string, score double")
    sents = spark.createDataFrame([(1, 0, line.split())], "doc_id long, sent_id long, words array<string>")
    got = groups.noun_groups(sents, groups.best_tags(morph)).orderBy("pos").collect()
    assert [r.term for r in got] == found
    words = line.split()
    assert all(words[r.pos : r.pos + r.n_words] == r.term.split() for r in got)


def test_nested_groups(spark):
    morph = spark.createDataFrame([(w, w, *t, 1.0) for w, t in TAGS.items()], "word string, lemma string, pos string, gcase string, number string, score double")
    sents = spark.createDataFrame([(1, 0, ["N", "n", "g"]), (1, 1, ["n"])], "doc_id long, sent_id long, words array<string>")
    got = groups.nested_counts(groups.noun_groups(sents, groups.best_tags(morph), nested=True)).collect()
    assert {(r.term, r.n, r.alone) for r in got} == {("N n g", 1, 1), ("N n", 1, 0), ("n", 2, 1), ("n g", 1, 0), ("g", 1, 0)}
