"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import tokens as tk
from lexmill.llm import components, decontaminate, hmm, jaccard, mixing, neardup, quality, secrets, sharding, spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, key long, score double"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, ties."""
    rng = random.Random(4)
    passage = words(rng, 30)
    texts = [None, "", "   \n\t", "one", "One TWO three", "one two three", "x " * 3000]
    base = words(rng, 120)
    for k in range(40):
        near = list(base)
        for _ in range(rng.randrange(0, 8)):
            near[rng.randrange(len(near))] = f"n{k}"
        texts.append(" ".join(near))
    texts += [texts[10]] * 5
    for _ in range(30):
        own = words(rng, rng.randrange(5, 90))
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage * rng.randrange(0, 2) + own[at:]))
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, 2, 0.5) for i, t in rows], SCHEMA)


def shingles(text, n):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 90)])
def test_jaccard_links(spark, corpus, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 8)  # several blocks of a list
    sets = {i: shingles(t, n) for i, t in corpus}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, corpus), n, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")]
    got = jaccard.link(frame(spark, rows)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}
    assert jaccard.link(frame(spark, rows).limit(0)).count() == 0


def test_components_in_rounds_equal_one_task(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = groups({x for e in edges for x in e}, edges)
    rows = spark.createDataFrame(edges, "a long, b long")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for limit in (10**6, 0):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        assert {r.node: r.component for r in components.components(rows).distinct().collect()} == {x: want[x] for x in linked}


def removed(rows, k):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, str(r[0]) if isinstance(r[0], str) else r[0] or 0, r[1] is not None, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            gram = tuple(w[p : p + k])
            if gram in seen:
                gone[p : p + k] = [True] * k
            seen.add(gram)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def spanned(spark, rows, k, kind="long"):
    return Counter(tuple(r) for r in spans.dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id {kind}, text string, key string"), k).collect())


def test_spans(spark, corpus):
    assert spanned(spark, corpus, 20) == removed(corpus, 20)
    assert spans.dedup(frame(spark, corpus).limit(0), 20).count() == 0


def test_spans_of_repeated_ids(spark, corpus):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(5, "z " + " ".join(f"u{i}" for i in range(40))), (5, "b c d " + passage), (3, passage + " end"), (8, "a " + passage), (8, "b " + passage), (None, passage), (None, "q " + passage), (9, passage), (9, passage), (9, " " + passage)]
    rows += [(rng.randrange(20), t) for _, t in corpus]
    assert spanned(spark, rows, 12) == removed(rows, 12)
    named = [(None if i is None else f"d{i}", t) for i, t in rows]
    assert spanned(spark, named, 12, "string") == removed(named, 12)


@pytest.mark.parametrize("values", [{"window_hashes": 16}, {"window_hashes": 16, "word_hashes": 8, "text_keys": 4}])
def test_spans_when_hashes_collide(spark, corpus, monkeypatch, values):
    """Collisions of windows change nothing; those of neighbours and whole texts may leave a repeat, but remove no other word."""

    def fewer(name):
        whole, most = getattr(tk, name), np.uint64(values[name])
        return lambda *x: whole(*x) % most

    # an object travels to the workers by value, a module would not
    kernels = {name: getattr(tk, name) for name in ("split", "slices", "signed", "mix", "word_hashes", "window_hashes", "text_keys")}
    monkeypatch.setattr(spans, "tk", SimpleNamespace(**kernels | {name: fewer(name) for name in values}))
    got, want = spanned(spark, corpus, 20), removed(corpus, 20)
    if len(values) == 1:
        assert got == want
    most = {x[0]: x[2] for x in want}
    assert got.total() == want.total() and all(x[2] <= most[x[0]] for x in got)


@pytest.mark.parametrize("hot", [1, 10**6])
def test_spans_of_common_paths(spark, corpus, monkeypatch, hot):
    """All keys joined by key (nothing is more than all rows), and all by broadcast."""
    monkeypatch.setattr(spans, "HOT", hot)
    assert spanned(spark, corpus, 20) == removed(corpus, 20)


@pytest.mark.parametrize("block, leaf, run", [(32, 8, 8), (8, 4, 2)])
def test_embeddings(spark, monkeypatch, block, leaf, run):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "RUN", run)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(scale=0.15, size=16)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(5)] + [(160, None), (161, [0.0] * 16), (162, [float("nan")] * 16), (163, [None] + [1.0] * 15), (164, []), (165, [1.0, 2.0]), (166, [2.0, 4.0]), (167, [float("inf")] * 16)]
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / (math.sqrt(good[a] @ good[a]) * math.sqrt(good[b] @ good[b])) >= 0.95]
    want, n = groups([i for i, _ in rows], links), Counter(x for e in links for x in e)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.link(table).collect()}
    assert links and got == {i: (n[i], want[i], want[i] == i) for i, _ in rows}
    assert neardup.link(table.limit(0)).count() == 0


def test_sharding(spark, corpus):
    rows = [(i, t) for i, t in corpus] + [(None, "null id"), (3, "one")]
    got = sharding.shard(frame(spark, rows)).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = dict(corpus)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id not in (None, 3))
    assert sharding.shard(frame(spark, rows).limit(0)).count() == 0


def test_sharding_moves_few_rows(spark):
    rows = [(i, f"t{i}") for i in range(4000)]
    place = lambda n: {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), n).collect()}
    a, b = place(8), place(9)
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)


def test_sharding_equals_sql(spark, corpus):
    rows = [(i, t) for i, t in corpus if t is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", rows)
    want = {r[0]: r[3:] for r in con.sql(sharding.shard_sql().replace("{docs}", "docs").replace("{crc}", "0")).fetchall()}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(frame(spark, rows)).collect()} == want


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 40)))) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "big" if i % 10 < 6 else None if i % 10 == 6 else "mid" if i % 10 < 9 else "tiny") for i, t in rows], "doc_id long, text string, source string")
    plan = mixing.schedule(docs, repetitions=2.0, block_docs=50).cache()
    uses = Counter(r.doc_id for r in plan.collect())
    assert set(uses) == set(range(600)) and max(uses.values()) <= 2 + 1
    for (source, epoch), run in itertools.groupby(plan.orderBy("source", "epoch", "token_start", "doc_id").collect(), lambda r: (r.source, r.epoch)):
        run = sorted(run, key=lambda r: (r.token_start, r.n_tokens))
        assert [r.token_start for r in run] == list(itertools.accumulate([r.n_tokens for r in run[:-1]], initial=0))
    mixed = mixing.mix(docs, repetitions=2.0, block_docs=50)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == uses
    assert mixing.schedule(docs.limit(0)).count() == 0
    even = {r.source: r.weight for r in mixing.weights(docs.groupBy("source").agg(F.lit(10).alias("docs"), F.sum(F.length("text")).alias("tokens")).where("source is not null"), None, math.log2(3) - 0.01, None, 50).collect()}
    assert abs(sum(even.values()) - 1) < 1e-9 and -sum(w * math.log2(w) for w in even.values()) >= math.log2(3) - 0.011


def test_mixing_returns_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 2}", f"q{i}", i, "u", -i) for i in range(20)], "doc_id long, text string, source string, mix string, times int, use string, whole int")
    mixed = mixing.mix(docs, repetitions=2.0, block_docs=5)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == {tuple(r) for r in docs.collect()}


def test_dictionary_words_cover_long_runs():
    words = np.sort(tk.word_hashes(tk.split(pa.array(["token key secret"]))))
    assert secrets.covered(b"SecretKeyX1", words) == 9 / 11 and secrets.covered(b"zz", words) == 0.0
    assert secrets.covered(b"key1" * 50_000, words) == 0.75


def labelled(spark, rows, column):
    return spark.createDataFrame([(i, v) for i, v in rows], f"doc_id long, {column} int")


def test_quality_learns_junk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        w = words(rng, rng.randrange(20, 80))
        rows.append((i, " ".join(x + "$$$" for x in w) if i % 4 == 0 else " ".join(w) + "."))
    rows += [(600, None), (601, "")]
    labels = labelled(spark, [(i, int(i % 4 != 0)) for i in range(500)] + [(600, None)], "quality")
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), labels, features=60).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == int(i % 4 != 0) for i in range(500) if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in range(500))
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    none = quality.classify(frame(spark, rows), labels.limit(0), features=20).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x, n = np.arange(200.0), np.ones(200)
    y = (rng.random(200) < x / 200).astype(float)
    knots, level = quality.isotonic(x, n, y)
    assert (np.diff(level) >= 0).all() and (np.diff(knots) > 0).all()


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        w = words(rng, 40)
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(["Nasty!", "vile,"])
        rows.append((i, " ".join(w)))
    rows += [(700, None), (701, "")]
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, rows), labelled(spark, [(i, int(i % 5 == 0)) for i in range(600)], "toxic")).collect()}
    assert len(got) == 602 and all(got[i].predicted == int(i % 5 == 0) for i in range(600)) and got[700].predicted == 0
    assert toxicity.classify(frame(spark, rows), labelled(spark, [], "toxic")).select("score").distinct().first().score == 0.0


def test_toxic_words_do_not_depend_on_the_sizes_of_the_samples(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = words(rng, 20)
        if rng.random() < (0.7 if toxic else 0.05):
            w[5] = "vile"
        rows.append((i, "a clean text of many copies" if i % 3 == 1 else " ".join(w)))
        labels.append((i, int(toxic)))
    vile = toxicity.term_hashes(pa.array(["vile"]))[0][0]
    for most in (100, 900):
        # at 100 both classes are at the cap; a third of all rows is one clean text
        some, sizes = toxicity.examples(frame(spark, rows), labelled(spark, labels, "toxic"), most)
        assert len(sizes) == 2 and vile in toxicity.choose_terms(some.select("text", "label"), 2048, 30.0)
    even = [(" ".join(words(rng, 20)) + (" vile" if rng.random() < (0.7 if i % 2 else 0.05) else ""), i % 2) for i in range(400)]
    assert vile in toxicity.choose_terms(spark.createDataFrame(even, "text string, label int"), 2048, 30.0)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(900):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index(vectors, np.arange(900), np.zeros(900), np.ones(900), 40)
    dense = np.zeros((900, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 900, 30):
        want = np.sort(np.delete(dense @ dense[q], q))[::-1][:15]
        _, got = index.nearest(vectors[q], 15, q)
        assert np.allclose(got, want[want > 0][: len(got)]) and len(got) == min(15, (want > 0).sum())


def test_hmm_base_and_likelihood(spark, corpus):
    got = {r.doc_id: r for r in hmm.score(frame(spark, corpus), states=3, rounds=2, emit=50, head=100, shares=3).collect()}
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in corpus}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r.score <= 0
    assert hmm.score(frame(spark, corpus).limit(0), states=2, rounds=1, shares=2).count() == 0


def test_hmm_forward_and_expectations_match_enumeration():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((4, 2)), 0))
    seqs = [np.array([0, 3, 1, 2]), np.array([2]), np.array([1, 1, 0])]
    expected, want_logs = np.zeros(2 + 4 + 8), []
    for s in seqs:
        weights = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        want_logs.append(math.log10(total))
        for path, p in weights.items():
            expected[path[0]] += p / total
            for t in range(1, len(s)):
                expected[2 + 2 * path[t - 1] + path[t]] += p / total
            for x, z in zip(s, path):
                expected[6 + 2 * x + z] += p / total
    assert np.allclose(model.log10(seqs), want_logs) and np.allclose(model.expected(seqs), expected, atol=1e-4)


def test_hmm_expectations_of_long_texts_are_those_of_the_whole_text():
    """Smoothing over the whole text in double precision, one text at a time; no cut resets the state."""
    rng = np.random.default_rng(8)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)) ** 4, 1), norm(rng.random((9, 3)) ** 3, 0))
    seqs, want = [rng.integers(0, 9, n) for n in (3000, 1, 700, 1500)], np.zeros(3 + 9 + 27)
    for s in seqs:
        alpha, beta = np.zeros((len(s), 3)), np.ones((len(s), 3))
        for t, x in enumerate(s):
            alpha[t] = norm((model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[x], 0)
        for t in range(len(s) - 2, -1, -1):
            beta[t] = norm(model.move @ (model.emit[s[t + 1]] * beta[t + 1]), 0)
            want[3:12] += norm(np.outer(alpha[t], model.emit[s[t + 1]] * beta[t + 1]) * model.move, (0, 1)).ravel()
        gamma = norm(alpha * beta, 1)
        want[:3] += gamma[0]
        np.add.at(want[12:].reshape(9, 3), s, gamma)
    assert np.allclose(model.expected(seqs), want, rtol=1e-3, atol=1e-2)
    assert not hmm.Hmm.noisy(np.ones(4) / 4, 2).expected([]).any()


@pytest.mark.parametrize("emit, head", [(50, 100), (4, 6), (2000, 7), (1, 1)])
def test_hmm_lexicon_takes_words_of_equal_counts(spark, emit, head):
    """All words have one count: some have symbols of their own, and classes hold exactly the rest."""
    rows = spark.createDataFrame([(rows_word(i), i % hmm.CLASSES, 4) for i in range(50)], "word long, class int, n long")
    lex = hmm.lexicon(rows, 3, emit, head)
    assert len(lex.words) <= min(50, head + 1) and lex.own == min(emit, len(lex.words)) and (head < 5 or lex.own)
    assert lex.class_words.sum() == 50 - lex.own and lex.class_tokens.sum() == 4 * (50 - lex.own) and lex.tokens == 203
    own = set(lex.words[lex.symbols >= 0].view(np.int64).tolist())
    assert lex.class_words.tolist() == [sum(1 for i in range(50) if i % hmm.CLASSES == c and rows_word(i) not in own) for c in range(hmm.CLASSES)]


def rows_word(i):
    return i * (2**64 // 50) - 2**63


def test_hmm_of_repeated_rows_ids_and_extra_columns(spark, corpus):
    rows = [*corpus[:20], *corpus[:20], (None, "one two"), (3, "other text")]
    got = hmm.score(frame(spark, rows).withColumn("row", F.lit("x")).withColumn("word", F.lit(1)), states=2, rounds=1, emit=50, head=100, shares=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 9))
    assert len(same) == 22 and all(len(x) == 1 for x in same.values())


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 40, 5000))) for i in range(6)] + [(90, None), (91, ""), (92, "w1 w2 w3")]
    rows = [(i, " ".join(words(rng, 150, 5000))) for i in range(60)]
    for i in range(6):
        w = rows[i][1].split()
        leaked = items[i][1].split()
        for _ in range(i):  # paraphrases: up to five words replaced
            leaked[rng.randrange(40)] = "other"
        at = rng.randrange(150)
        rows[i] = (i, " ".join(w[:at] + [x.upper() + "," for x in leaked] + w[at:]))
    rows += [(70, None), (71, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(6)} and all(r.covered >= 0.8 for r in got)
    assert decontaminate.search(frame(spark, rows), bench.limit(0)).count() == 0 == decontaminate.search(frame(spark, rows).limit(0), bench).count()


def test_decontamination_with_more_passages_than_axes(spark, monkeypatch):
    rng = random.Random(12)
    items = [words(rng, 40, 3000) for _ in range(120)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = []
    for i, item in enumerate(items):
        near = [w if rng.random() < 0.7 else f"o{rng.randrange(3000)}" for w in item]
        rows.append((i, " ".join([f"o{rng.randrange(3000)}" for _ in range(50)] + near + [f"o{rng.randrange(3000)}" for _ in range(50)])))
    full = {(r.doc_id, r.item_id) for r in decontaminate.search(frame(spark, rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "RANK", 8)
    assert len(full) > 40 and full <= {(r.doc_id, r.item_id) for r in decontaminate.search(frame(spark, rows), bench).collect()}


def leaks(rows, items, cosine=0.3, least=0.6):
    """All windows against all passages (items of up to 64 words), by the untruncated cosine and plain subsequences."""
    strip = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in (t or "").lower().split()) if w]
    texts = {i: strip(t) for i, t in rows}
    blocks = [set(w[a : a + 16]) for w in texts.values() for a in range(0, len(w), 16)]
    seen = Counter(x for b in blocks for x in b)

    def vector(words):
        v = {x: (1 + math.log(n)) * (math.log((len(blocks) + 1) / (seen[x] + 1)) + 0.01) for x, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values())) or 1.0

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    found = set()
    passages = [(k, strip(t), strip(answer)) for k, t, answer in items]
    weights = [vector(words) for _, words, _ in passages]
    for i, words in texts.items():
        for a, z in {(a, min(len(words), a + 16 * span)) for a in range(0, len(words), 16) for span in (2, 4)}:
            v, length = vector(words[a:z])
            for (k, passage, answer), (p, size) in zip(passages, weights):
                if (i, k) in found or not passage or sum(v[x] * p[x] for x in v.keys() & p.keys()) < cosine * length * size:
                    continue
                near, most = words[max(0, a - len(passage)) : z + len(passage)], int(1.5 * len(passage) + 4)
                for lo in range(len(near)):
                    here = near[lo : lo + most]
                    if sum(x in here for x in set(answer)) >= 0.5 * len(set(answer)) and common(passage, here) >= least * len(passage):
                        found.add((i, k))
                        break
    return found


def test_decontamination_against_all_windows_and_passages(spark):
    rng = random.Random(21)
    items = [(k, " ".join(words(rng, rng.randrange(12, 60), 600))) for k in range(25)]
    items = [(k, t, " ".join(t.split()[-3:])) for k, t in items]
    rows = []
    for i in range(80):
        w = words(rng, rng.randrange(20, 200), 600)
        copy = items[i % 25][1].split()
        for _ in range(rng.randrange(0, len(copy) // 2)):  # up to half of the words replaced
            copy[rng.randrange(len(copy))] = f"o{rng.randrange(50)}"
        at = rng.randrange(len(w))
        rows.append((i, " ".join(w[:at] + (copy if i % 4 else []) + ["junk"] * (40 * (i % 5 == 0)) + w[at:])))
    want = leaks(rows, items)
    bench = spark.createDataFrame(items, "item_id int, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(frame(spark, rows), bench, answer="answer").collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.95 * len(want)


def test_decontamination_in_chunks_and_with_any_ids(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 3)
    monkeypatch.setattr(decontaminate, "TERMS", 64)
    rng = random.Random(22)
    items = [(None if k == 4 else k, " ".join(words(rng, 30, 5000))) for k in range(8)] + [(7, None)]
    items.append(items[2])
    rows = [(f"d{k}", " ".join(words(rng, 40, 5000) + t.split() + words(rng, 40, 5000))) for k, (_, t) in enumerate(items[:8])] + [(None, items[0][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id string, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.search(docs, spark.createDataFrame(items, "item_id int, text string")).collect())
    assert got == Counter([(f"d{k}", items[k][0]) for k in range(8)] + [("d2", 2), (None, 0)])


def test_stretches_leave_out_words_far_before():
    passage, filler = np.arange(20), np.arange(100, 130)
    copy = np.concatenate([filler[:5], [0], filler, passage, filler[:3]])
    assert next(decontaminate.stretches(passage, copy, 34, 12)) == (20, 36, 56)
    # the first word is lost in the copy, but stands far before it
    paraphrase = np.concatenate([[0], filler, passage[1:], filler[:3]])
    assert next(decontaminate.stretches(passage, paraphrase, 34, 12)) == (19, 31, 50)
    assert not list(decontaminate.stretches(passage, filler, 34, 12))
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 8, 6), rng.integers(0, 8, 30)
        best = max(decontaminate.lcs(a, b[i : i + 13])[0] for i in range(30))
        got = list(decontaminate.stretches(a, b, 13, 1))
        assert got and max(n for n, _, _ in got) == best and all(hi - lo <= 13 and decontaminate.lcs(a, b[lo:hi])[0] >= n for n, lo, hi in got)


def test_copies_after_an_earlier_first_word(spark):
    item = "the " + " ".join(f"q{i}" for i in range(24))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, " ".join(["the" if j == i else f"f{i}x{j}" for j in range(30)] + item.split() + [f"g{i}x{j}" for j in range(30)])) for i in range(2, 29)]
    got = decontaminate.search(frame(spark, rows), bench).collect()
    assert {r.doc_id for r in got} == set(range(2, 29)) and all(r.n_words <= 41 for r in got)


def test_short_items_are_found_whole(spark):
    rng = random.Random(13)
    items = ["alpha", "beta gamma", "delta eps zeta", "w1 w2 w3 w4 w5 w6 w7"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, "eta theta")], "item_id long, text string")
    rows = [(i, " ".join([f"r{i}x{j}" for j in range(60)] + [item.upper() + "."] + [f"s{i}x{j}" for j in range(60)])) for i, item in enumerate(items)]
    rows += [(10, "eta of theta"), (11, "beta"), (12, "gamma"), (13, "delta eps " + " ".join(words(rng, 80)) + " zeta"), (14, None)]
    got = decontaminate.search(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words) for r in got} == {(i, i, 60, len(item.split())) for i, item in enumerate(items)}


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b))[0] == t[-1][-1]


def test_secrets(spark):
    rng = random.Random(9)
    rows, secret = [], set()
    for i in range(120):
        w = words(rng, 30)
        if i % 3 == 0:
            w[10] = 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'
            secret.add(i)
        else:
            w[10] = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, "")]
    got = secrets.scan(frame(spark, rows), trees=10).collect()
    assert {r.doc_id for r in got} == set(range(120)) and {r.doc_id for r in got if r.is_secret} == secret
    text = dict(rows)
    assert all(text[r.doc_id][r.start :].startswith(r.preview[:4]) for r in got)
    assert secrets.scan(frame(spark, rows).limit(0)).count() == 0
