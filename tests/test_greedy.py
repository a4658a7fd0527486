"""Greedy choices in order, near words, and term clusters against walks over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import scores
from lexmill.operators import families, rounds, terms


def walk_leaders(order, linked):
    leaders, out = [], {}
    for x in order:
        at = next((y for y in leaders if (x, y) in linked or (y, x) in linked), None)
        out[x] = x if at is None else at
        if at is None:
            leaders.append(x)
    return out


@pytest.mark.parametrize("n,p", [(0, 0), (1, 0), (60, 0.02), (60, 0.1), (40, 0.6)])
def test_leaders_are_those_of_the_walk(spark, n, p):
    rng = random.Random(n)
    order = list(range(n))
    rng.shuffle(order)
    linked = {(a, b) for a in range(n) for b in range(n) if rng.random() < p}  # some both ways, some loops
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "id long, ord long")
    links = spark.createDataFrame(list(linked), "a long, b long")
    assert {r.id: r.leader for r in rounds.leaders(nodes, links).collect()} == walk_leaders(order, linked)


def test_leaders_along_a_chain(spark):
    nodes = spark.createDataFrame([(x, x) for x in range(9)], "id long, ord long")
    links = spark.createDataFrame([(x, x + 1) for x in range(8)], "a long, b long")
    assert {r.id: r.leader for r in rounds.leaders(nodes, links).collect()} == {x: x - x % 2 for x in range(9)}


def some_words(seed, letters="abcde"):
    rng = random.Random(seed)
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))) for _ in range(90)}
    for w in sorted(out):
        x = list(w)
        for _ in range(rng.randrange(1, 3)):
            i, kind = rng.randrange(len(x) + 1), rng.randrange(3)
            x[i : i + (kind != 0)] = [rng.choice(letters)] if kind != 1 else []
        out.add("".join(rng.choice(letters) for _ in range(rng.randrange(0, 4))) + "".join(x) or "a")
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_related_words_are_all_near_pairs(spark, seed):
    words = some_words(seed) + ["наблюдение", "наблюдению", "наблюдатель", "ёж"]
    rows = spark.createDataFrame([(w, k) for w in words for k in ("x", None) if k or len(w) % 2], "word string, k string")
    got = {(r.w1, r.w2): round(r.distance, 9) for r in families.related(rows).collect()}
    a, b = (spark.createDataFrame([(w,) for w in words], f"w{i} string") for i in (1, 2))
    every = a.crossJoin(b).where("w1 < w2").withColumn("d", scores.word_distance("w1", "w2")).where("d <= 1")
    assert got == {(r.w1, r.w2): round(r.d, 9) for r in every.collect()}
    by_group = families.related(rows.fillna("none"), "k").groupBy("k").count().collect()
    assert {r.k for r in by_group} == {"x", "none"} and next(r["count"] for r in by_group if r.k == "x") == len(got)


def test_candidates_are_a_small_part_of_all_pairs(spark):
    words = sorted({"".join(random.Random(i).choices("bcdfglmnprst", k=1)[0] + v for v in random.Random(-i).choices("aeiou", k=4)) + str(i % 7) for i in range(600)})
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    short, long_ = (rows.select(F.col("word").alias(c), F.explode(F.expr(families._keys("word").format(pieces="array(0L)"))).alias("key")) for c in "sl")
    met = short.join(long_, "key").where("s < l").select("s", "l").distinct().count()
    assert met < 0.05 * len(words) * (len(words) - 1) / 2


def walk_families(words, distance):
    out = []
    for w in words:
        best, home = None, None
        for f in out:
            total, zero = 0.0, False
            for x in f:
                d = distance(w, x)
                if d > 1:
                    break
                total, zero = total + d, zero or d == 0
            else:
                if best is None or total / len(f) < best:
                    best, home = total / len(f), f
            if zero:
                home = f
                break
        if home is None:
            out.append([w])
        else:
            home.append(w)
    return sorted(map(sorted, out))


def test_families_are_those_of_the_walk(spark):
    groups = {g: some_words(g + 10, "abc") for g in range(3)}
    for g, words in groups.items():
        random.Random(g).shuffle(words)
    rows = spark.createDataFrame([(g, i, w) for g, words in groups.items() for i, w in enumerate(words)], "group long, ord int, word string")
    every = sorted({w for words in groups.values() for w in words})
    a, b = (spark.createDataFrame([(w,) for w in every], f"w{i} string") for i in (1, 2))
    table = {(r.w1, r.w2): r.d for r in a.crossJoin(b).where("w1 < w2").withColumn("d", scores.word_distance("w1", "w2")).collect()}
    got = {}
    for r in families.families(rows).collect():
        got.setdefault(r.group, {}).setdefault(r.family, []).append(r.word)
    for g, words in groups.items():
        assert sorted(map(sorted, got[g].values())) == walk_families(words, lambda x, y: table[min(x, y), max(x, y)])


def walk_terms(rows):
    """rows of one key: (term, words, n, lemmas, scores)."""
    clusters, out = [], []
    for r in sorted(rows, key=lambda r: (-r[2], -len(r[1]), r[0])):
        home = next((c for c in clusters if len(c[0][3]) == len(r[3]) and all(set(x) & set(y) for x, y in zip(c[0][3], r[3]))), None)
        if home is None:
            clusters.append([r])
        else:
            home.append(r)
    for c in clusters:
        if len(c) == 1:
            if min(c[0][4].values()) >= 0:
                out.append((c[0][0], c[0][2], 1))
            continue
        common, stay = {x for p in c[0][3] for x in p}, []
        for r in c:
            shared = common & {x for p in r[3] for x in p}
            if shared:
                common, stay = shared, [*stay, r]
            else:
                out.append((r[0], r[2], 1))
        sums = [sum(r[4].get(x, 0) for x in common) for r in stay]
        if max(sums) <= 0:
            out += [(r[0], r[2], 1) for r in stay]
        else:
            out.append((stay[sums.index(max(sums))][0], sum(r[2] for r in stay), len(stay)))
    return sorted(out)


def test_joined_terms_are_those_of_the_walk(spark):
    rng = random.Random(3)
    rows = []
    for doc in (1, 2, None):
        for i in range(120 if doc == 1 else 25):
            size = rng.choice([1, 1, 2, 3])
            lemmas = [sorted(rng.sample("abcdefgh", rng.choice([1, 1, 2]))) for _ in range(size)]
            scored = {x: rng.choice([-1.0, 0.0, 1.0, 2.0, 5.0]) for p in lemmas for x in p}
            rows.append((doc or 0, f"t{i}", [f"t{i}"] * size, rng.randrange(1, 6), lemmas, scored))
    got = terms.join_terms(spark.createDataFrame(rows, "doc_id long, term string, words array<string>, n long, lemmas array<array<string>>, scores map<string,double>"))
    for doc in (1, 2, 0):
        assert sorted((r.term, r.n, r.members) for r in got.where(F.col("doc_id") == doc).collect()) == walk_terms([r[1:] for r in rows if r[0] == doc])
