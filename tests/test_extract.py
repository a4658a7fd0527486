"""Extraction from files, its rankings against a plain model, and books."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill import extract
from lexmill.operators import book, extraction, terms

STOP = ["the", "and"]


def some_text(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "and", "of", "omega"]
    return " ".join(" ".join(rng.choices(words, k=rng.randrange(2, 9))).capitalize() + "." for _ in range(n))


def model_rankings(text, ks, least, limit):
    sents = [s.lower().split() for s in text.replace(".", "").split("\n")] if "\n" in text else [s.strip(". ").lower().split() for s in text.split(". ")]
    ok = lambda w: len(w) >= 3 and w not in STOP
    occ, t, clock = [], 0, []
    for words in sents:
        t += len(words)
        clock.append(t)
        for i, w in enumerate(words):
            if ok(w):
                occ.append((w, 1, t))
                if i + 1 < len(words) and ok(words[i + 1]):
                    occ.append((f"{w} {words[i + 1]}", 2, t))
    counts, out = Counter(o[0] for o in occ), {}
    ranked = {"freq": counts}
    for k in ks:
        parts = len(sents) // k
        if parts < 2:
            continue
        width = math.ceil(t / parts)
        bins = (t - clock[0]) // width + 1
        cells = {}
        for term, n, at in occ:
            cells.setdefault((term, n), [0] * bins)[(at - clock[0]) // width] += 1
        ranked[f"stdev-{k}s"] = {term: (statistics.stdev(c) if bins > 1 else 0) * n for (term, n), c in cells.items()}
    if len(ranked) == 1:
        return {}
    for name, scores in ranked.items():
        kept = sorted((-round(v, 9), term) for term, v in scores.items() if counts[term] >= least)
        out[name] = [term for _, term in kept][:limit]
    return out


@pytest.mark.parametrize("limit", [None, 5])
def test_rankings_and_what_they_agree_on(spark, limit):
    texts = {i: some_text(i, n) for i, n in enumerate([60, 25, 8])} | {9: "Too short. Text."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = extraction.rankings(docs, STOP, sent_by_part=[5, 20], min_count=2, limit=limit)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.doc_id, {}).setdefault(r.algorithm, []).append(r.term)
    want = {i: w for i, t in texts.items() if len(t) > 100 and (w := model_rankings(t, [5, 20], 2, limit))}
    assert got == want and set(want[0]) == {"freq", "stdev-5s", "stdev-20s"} and 9 not in got
    agreed = {}
    for r in extraction.agreed(found).collect():
        agreed.setdefault(r.doc_id, set()).add(r.term)
    assert agreed == {i: x for i, w in want.items() if (x := set.intersection(*map(set, w.values())))}
    with pytest.raises(ValueError):
        extraction.rankings(docs, STOP, sent_by_part=[0])


def test_parts_instead_of_sentences(spark):
    docs = spark.createDataFrame([(1, some_text(1, 40))], "doc_id long, text string")
    found = extraction.rankings(docs, STOP, parts=[8])
    assert {r.algorithm for r in found.select("algorithm").distinct().collect()} == {"freq", "stdev-8p"}
    same = extraction.rankings(docs, STOP, sent_by_part=[5])
    rows = lambda df, a: sorted((r.term, round(r.score, 9)) for r in df.where(F.col("algorithm") == a).collect())
    assert rows(found, "stdev-8p") == rows(same, "stdev-5s")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"t{i}.txt").write_text(some_text(i, 60), encoding="utf-8")
    (tmp_path / "in" / "short.txt").write_text("nothing here", encoding="utf-8")
    (tmp_path / "stop.txt").write_text("the and", encoding="utf-8")
    target = extract.run(spark, str(tmp_path / "in"), [5, 20], 2, 6, str(tmp_path / "result"), str(tmp_path / "stop.txt"))
    assert target.endswith("/extracted-min2-lim6.txt")
    for i in range(2):
        lines = [r.value for r in spark.read.text(f"{target}/text=t{i}.txt").collect()]
        want = sorted(set.intersection(*map(set, model_rankings(some_text(i, 60), [5, 20], 2, 6).values())))
        assert lines[0].startswith("# Source text: ") and lines[0].endswith(f"t{i}.txt")
        assert lines[1:] == ["# Parameters : sent_by_part=5,20 limit=6 min_count=2", f"# Terms extracted: {len(want)}", "", *want] and want
    assert [r.value for r in spark.read.text(f"{target}/text=short.txt").collect()][2:] == ["# Terms extracted: 0", ""]
    assert extract.main(["x", "--min_count", "0"]) == 2 and "positive" in capsys.readouterr().err
    assert extract.arguments(["x"]).sent_by_part == [40]


def test_books(spark):
    rows = [("a", 1, some_text(1, 30)), ("a", 2, some_text(2, 20)), ("b", 1, some_text(3, 9)), ("b", 7, "")]
    books = book.Books(spark.createDataFrame(rows[:2], "book string, doc_id long, text string"), STOP).with_chapters(spark.createDataFrame(rows[2:], "book string, doc_id long, text string"))
    sizes = {r.book: (r.chapters, r.n_sentences, r.n_words) for r in books.sizes().collect()}
    words = {k: [w for b, _, t in rows if b == k for w in t.lower().replace(".", "").split()] for k in "ab"}
    assert sizes == {"a": (2, 50, len(words["a"])), "b": (1, 9, len(words["b"]))}
    counts = {(r.book, r.word): r.n for r in books.count_of(spark.createDataFrame([("alpha",), ("none",)], "word string")).collect()}
    assert counts == {(k, "alpha"): words[k].count("alpha") for k in "ab"}
    assert [(r.book, r.n) for r in books.find_terms("omega", exact=True).orderBy("book").collect()] == [(k, words[k].count("omega")) for k in "ab"]
    top = books.candidates(3).where("book = 'a'").orderBy("rank").collect()
    assert len(top) == 3 and top[0].n == max(words["a"].count(w) for w in ("alpha", "beta", "gamma", "delta", "omega"))
    assert {r.df for r in books.document_frequency().where("term = 'alpha'").collect()} <= {1, 2}
    ranks = books.stdev_rank(limit=4)
    assert ranks.groupBy("book").count().collect()[0]["count"] == 4 and books.terms_by_chapter().columns == ["book", "doc_id", "rank", "term", "value"]
    assert books.chapters_with_terms(1, 0.0).where("term = 'alpha'").count() == 3
    assert terms.top(books.counts, "n", 1, "book", "doc_id").count() == 3
