"""Rankings of each source evaluated against test sets made of the benchmark's terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import corpus, evaluation, terms
from lexmill.operators.rounds import dealt, settled

from .base import CANDIDATES, PRE, STOP, documents, query, quoted, rounded, sentence_sql, table, words_frame

TOP = 60
SETS = (
    PRE
    + CANDIDATES
    + ", "
    + sentence_sql("benchmark", "item_id").replace("marked AS", "b_marked AS").replace("FROM marked", "FROM b_marked").replace("pieces AS", "b_pieces AS").replace("FROM pieces", "FROM b_pieces")
    .replace("lines AS", "b_lines AS").replace("FROM lines", "FROM b_lines").replace("sents AS", "b_sents AS").replace("FROM sents", "FROM b_sents").replace("tokens AS", "b_tokens AS")
    + f""",
    b_good AS (SELECT item_id, sent_id, pos, word FROM b_tokens WHERE len(word) >= 3 AND word NOT IN ({quoted(STOP)})),
    b_terms AS (SELECT DISTINCT term FROM (SELECT word AS term FROM b_good UNION ALL
      SELECT a.word || ' ' || b.word FROM b_good a JOIN b_good b ON a.item_id = b.item_id AND a.sent_id = b.sent_id AND b.pos = a.pos + 1)),
    tests AS MATERIALIZED (SELECT 'all' AS expert, term AS item FROM b_terms UNION ALL SELECT 'long', term FROM b_terms WHERE len(term) >= 7),
    books AS (SELECT doc_id, source AS book FROM documents),
    counts AS MATERIALIZED (SELECT b.book AS subject, o.term, count(*) AS n, count(DISTINCT o.doc_id) AS df FROM occ o JOIN books b USING (doc_id) GROUP BY ALL),
    ranked AS MATERIALIZED (
      SELECT subject, 'freq' AS alg, term, row_number() OVER (PARTITION BY subject ORDER BY n DESC, term) AS rank FROM counts
      UNION ALL SELECT subject, 'df', term, row_number() OVER (PARTITION BY subject ORDER BY df DESC, term) FROM counts),
    tops AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= {TOP}),
    evals AS (SELECT t.subject, t.alg, e.expert, t.rank, t.term FROM tops t, (SELECT DISTINCT expert FROM tests) e),
    runs AS (SELECT DISTINCT t.expert, t.item, n.m, array_to_string(w[i.i + 1:i.i + n.m], ' ') AS run, len(w) AS n2
      FROM (SELECT *, string_split(item, ' ') AS w FROM tests) t, (SELECT unnest([1, 2]) AS m) n, (SELECT unnest([0, 1]) AS i) i WHERE i.i + n.m <= len(w)),
    t_runs AS (SELECT DISTINCT term, n.m, array_to_string(w[i.i + 1:i.i + n.m], ' ') AS run, len(w) AS n1
      FROM (SELECT DISTINCT term, string_split(term, ' ') AS w FROM tops) t, (SELECT unnest([1, 2]) AS m) n, (SELECT unnest([0, 1]) AS i) i WHERE i.i + n.m <= len(w)),
    best AS (SELECT a.term, b.expert, max((a.m / a.n1) * (a.m / b.n2)) AS relevance FROM t_runs a JOIN runs b ON a.run = b.run GROUP BY ALL),
    judged AS MATERIALIZED (SELECT e.*, coalesce(b.relevance, 0)::DOUBLE AS relevance FROM evals e LEFT JOIN best b ON b.term = e.term AND b.expert = e.expert),
    n_items AS (SELECT expert, count(*) AS n_items FROM tests GROUP BY expert),
    at_k AS MATERIALIZED (
      SELECT subject, alg, expert, rank AS k, hits / rank AS precision, hits / n_items AS recall,
             CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / rank) * (hits / n_items) / (hits / rank + hits / n_items) END AS f1
      FROM (SELECT *, sum(round_even(relevance, 0)) OVER (PARTITION BY subject, alg, expert ORDER BY rank) AS hits FROM judged) JOIN n_items USING (expert)),
    aps AS MATERIALIZED (SELECT *, avg(precision) OVER (PARTITION BY subject, alg, expert ORDER BY k ROWS UNBOUNDED PRECEDING) AS ap FROM at_k)"""
)
KEYS = ("subject", "alg", "expert")


def _ranked(spark, d):
    """The first terms of each source by count and by document frequency: a few rows a source.

    Whole texts are dealt before they are cut, so a text's terms are counted where it is, and only a term's sums are
    shuffled. Each ranking is cut by its own window, so that every task keeps its first terms before a source's meet.
    """
    docs = documents(spark, d).select(F.struct(F.col("source").alias("subject"), "doc_id").alias("k"), "text")
    per_text = terms.candidates(corpus.sentences(dealt(docs, "k"), "k"), STOP, key="k").groupBy("k", "term").agg(F.count(F.lit(1)).alias("n"))
    found = per_text.groupBy("k.subject", "term").agg(F.sum("n").alias("n"), F.count("k.doc_id").alias("df"))
    both = F.array(*[F.struct(F.lit(a).alias("alg"), F.col(c).alias("by")) for a, c in (("freq", "n"), ("df", "df"))])
    return terms.top(found.select("subject", "term", F.inline(both)), "by", TOP, "subject", "alg").select("subject", "alg", "term", "rank")


def _rankings(spark, d):
    """The rows of ``_ranked``, made once and kept."""
    return settled(_ranked(spark, d))


def _tests(spark, d):
    items = corpus.sentences(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    found = terms.candidates(items, STOP, key="item_id").select(F.col("term").alias("item")).distinct()
    return settled(found.withColumn("expert", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.length("item") >= 7, "long"))))))


def _judged_with(ranked, tests):
    experts = tests.select("expert").distinct()
    best = evaluation.relevance(ranked.select("term").distinct().withColumn("rank", F.lit(0)).join(F.broadcast(experts)), tests, "expert").select("expert", "term", "relevance")  # the names of the test sets
    return ranked.join(best, "term")


def _judged(spark, d):
    return _judged_with(_rankings(spark, d), _tests(spark, d))


def _at_k(spark, d):
    ranked, tests = _rankings(spark, d), _tests(spark, d)
    sizes = tests.groupBy("expert").agg(F.count(F.lit(1)).alias("n_items")).join(ranked.select("subject", "alg").distinct())
    return evaluation.at_k(_judged_with(ranked, tests), sizes, *KEYS)


@query(SETS + " SELECT subject, alg, expert, rank::BIGINT AS rank, term, round(relevance, 6) AS relevance FROM judged")
def relevance(spark, d):
    return _judged(spark, d).select(*KEYS, "rank", "term", rounded("relevance"))


@query(SETS + " SELECT subject, alg, expert, rank::BIGINT AS rank, round_even(relevance, 0)::DOUBLE AS judged FROM judged")
def judged_at_k(spark, d):
    return _judged(spark, d).select(*KEYS, "rank", F.bround("relevance").alias("judged"))


def _measure(name: str, column: str):
    @query(SETS + f" SELECT subject, alg, expert, k::BIGINT AS k, round({column}, 6)::DOUBLE AS {column} FROM aps", name)
    def measured(spark, d):
        return _at_k(spark, d).select(*KEYS, "k", rounded(column))


for _name, _column in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("ap_at_k", "ap")):
    _measure(_name, _column)


@query(SETS + " SELECT alg, expert, k::BIGINT AS k, round(avg(f1), 6) AS mean_f1, count(*)::BIGINT AS observations FROM aps GROUP BY ALL")
def f1_at_k(spark, d):
    return evaluation.mean_by(_at_k(spark, d), "f1", "alg", "expert", "k").withColumn("mean_f1", F.round("mean_f1", 6))


@query(SETS + " SELECT alg, expert, k::BIGINT AS k, round(avg(recall), 6) AS mean_recall, count(*)::BIGINT AS observations FROM aps GROUP BY ALL")
def mean_recall_at_k(spark, d):
    return evaluation.mean_by(_at_k(spark, d), "recall", "alg", "expert", "k").withColumn("mean_recall", F.round("mean_recall", 6))


@query(SETS + " SELECT alg, k::BIGINT AS k, round(avg(ap), 6) AS mean_ap, count(*)::BIGINT AS observations FROM aps WHERE k IN (1, 5, 10, 20, 50) GROUP BY ALL")
def map_at_k(spark, d):
    return evaluation.mean_by(_at_k(spark, d).where(F.col("k").isin(1, 5, 10, 20, 50)), "ap", "alg", "k").withColumn("mean_ap", F.round("mean_ap", 6))


@query(SETS + " SELECT DISTINCT subject, alg, expert FROM evals")
def eval_cross(spark, d):
    ranked = _rankings(spark, d)
    tests = ranked.select("subject").distinct().join(F.broadcast(_tests(spark, d).select("expert").distinct()))
    return evaluation.cross(ranked, tests)


@query(
    """WITH labels AS (SELECT DISTINCT source AS label FROM documents), sizes AS (SELECT k FROM range(1, 10) t(k), labels GROUP BY k HAVING count(DISTINCT substr(label, 1, k)) = count(DISTINCT label))
    SELECT label, CASE WHEN (SELECT min(k) FROM sizes) IS NULL THEN label ELSE substr(label, 1, (SELECT min(k) FROM sizes)) END AS short FROM labels"""
)
def short_labels(spark, d):
    return evaluation.short_labels(documents(spark, d).select(F.col("source").alias("label")).distinct())


@query(r"SELECT page_id, regexp_replace(trim(regexp_replace(url, '[^\p{L}\p{N}_]+', ' ', 'g')), '\s+', '_', 'g') AS name, substr(url, 1, 8) AS short FROM pages")
def simplify_name(spark, d):
    return table(spark, d, "pages").select("page_id", tx.simplify_name(F.col("url")).alias("name"), tx.short_name(F.col("url")).alias("short"))


@query(
    SETS
    + """, phrases AS (SELECT expert, item, len(string_split(item, ' ')) AS size FROM tests),
    inside AS (SELECT DISTINCT expert, item, size, unnest(string_split(item, ' ')) AS term FROM phrases),
    sums AS (SELECT e.subject, e.alg, e.expert, sum(1.0::DOUBLE / i.size) AS hits FROM evals e JOIN inside i ON i.expert = e.expert AND i.term = e.term GROUP BY ALL),
    pr AS (SELECT t.subject, t.alg, t.expert, coalesce(s.hits, 0) / t.n AS p, coalesce(s.hits, 0) / i.n_items AS r
      FROM (SELECT subject, alg, expert, count(*) AS n FROM evals GROUP BY ALL) t JOIN n_items i USING (expert) LEFT JOIN sums s ON s.subject = t.subject AND s.alg = t.alg AND s.expert = t.expert)
    SELECT subject, alg, expert, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r <= 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr"""
)
def partial_credit_f1(spark, d):
    judged = _judged(spark, d)
    tests = _tests(spark, d).join(judged.select("subject", "alg").distinct())
    found = evaluation.partial_credit(judged.select(*KEYS, "term"), tests, *KEYS)
    return found.select(*KEYS, rounded("precision"), rounded("recall"), rounded("f1"))


@query(
    SETS
    + " SELECT a.subject, a.expert, a.k::BIGINT AS k, a.alg, CASE WHEN b.ap <> 0 THEN round(a.ap / b.ap, 6) END AS ratio FROM aps a JOIN aps b ON a.subject = b.subject AND a.expert = b.expert AND a.k = b.k AND b.alg = 'freq'"
)
def relative_ap(spark, d):
    found = evaluation.relative(_at_k(spark, d), "freq", "ap", "subject", "expert")
    return found.select("subject", "expert", "k", "alg", rounded("ratio"))


@query(SETS + " SELECT expert, k::BIGINT AS k, round(avg(ap) FILTER (alg = 'df'), 6) AS df, round(avg(ap) FILTER (alg = 'freq'), 6) AS freq FROM aps GROUP BY expert, k")
def ap_pivot(spark, d):
    wide = _at_k(spark, d).groupBy("expert", "k").pivot("alg", ["df", "freq"]).agg(F.avg("ap"))
    return wide.select("expert", "k", rounded("df"), rounded("freq"))


@query(
    "SELECT doc_id, len(repeat(text, ceil(1000 / greatest(len(text), 1))::INT))::BIGINT AS size FROM documents WHERE len(text) < 1000"
)
def eval_text(spark, d):
    """Short texts repeated to at least 1000 characters."""
    docs = documents(spark, d).where(F.length("text") < 1000)
    return docs.select("doc_id", F.length(evaluation.eval_text(F.col("text"), 1000)).cast("long").alias("size"))


EVALUATIONS = ", sized AS (SELECT e.subject, e.alg, e.expert, count(*)::BIGINT AS n_ranked, any_value(i.n_items)::BIGINT AS n_items FROM evals e JOIN n_items i ON i.expert = e.expert GROUP BY e.subject, e.alg, e.expert)"


def _evaluations(spark, d):
    """What is evaluated: each ranking with each test set, and how long both are."""
    ranked, tests = _rankings(spark, d), _tests(spark, d)
    sizes = ranked.groupBy("subject", "alg").agg(F.count(F.lit(1)).alias("n_ranked"))
    return sizes.join(F.broadcast(tests.groupBy("expert").agg(F.count(F.lit(1)).alias("n_items")))).select("subject", "alg", "expert", "n_ranked", "n_items")  # the names of the test sets


@query(SETS + EVALUATIONS + " SELECT * FROM sized WHERE expert = 'long' AND n_ranked >= 60 AND n_items > 0")
def valid_evaluations(spark, d):
    """Evaluations of one expert with enough ranked terms and a test set."""
    return evaluation.valid(_evaluations(spark, d), "long", 60)


@query(SETS + EVALUATIONS + " SELECT *, contains(subject, '1') AS marked FROM sized WHERE contains(alg, 'f') AND NOT contains(alg, 'freq')")
def named_evaluations(spark, d):
    """Evaluations by the names of their algorithms: with one mark, and without another."""
    rows = evaluation.named(evaluation.named(_evaluations(spark, d), "f"), "freq", without=True)
    return rows.withColumn("marked", F.col("subject").contains("1"))
