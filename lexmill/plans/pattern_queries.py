"""Definition patterns with Latin literals on the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import corpus, patterns

from .base import PRE, STOP, query, quoted, sents, table

PATTERNS = ["T is the T?", "the T?", "T? of T", "T? and T?", "la T", "T der T?"]
SIZES = [1, 2]
VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))
EXTENDED_OF = """
    given(pattern_no, p) AS ({given}),
    cut AS (SELECT pattern_no, string_split(p, 'T?') AS parts, len(string_split(p, 'T?')) - 1 AS optional FROM given),
    variants AS (SELECT *, unnest(range(0, (1 << optional)::BIGINT)) AS variant FROM cut),
    extended AS MATERIALIZED (
      SELECT pattern_no, variant::BIGINT AS variant,
             trim(regexp_replace(array_to_string(list_transform(range(0, len(parts)), lambda i: parts[i + 1] || CASE WHEN i < optional AND ((variant >> i) & 1) = 1 THEN 'T' ELSE '' END), ''), ' {{2,}}', ' ', 'g')) AS pattern
      FROM variants WHERE variant > 0 OR len(list_filter(parts, lambda x: regexp_matches(x, '\\bT\\b'))) > 0)"""
EXTENDED = EXTENDED_OF.format(given=f"VALUES {VALUES}")
#: Patterns around the first words of the benchmark's items.
FROM_ITEMS = EXTENDED_OF.format(given="SELECT item_id, 'T? ' || lower(w[1]) || ' ' || lower(w[2]) || ' T ' || lower(w[3]) FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) >= 3")
FILLED = """,
    pieces2 AS (SELECT DISTINCT pattern, list_filter(string_split(pattern, ' '), lambda x: x <> '') AS toks FROM extended),
    slotted AS (SELECT pattern, toks, len(list_filter(toks, lambda x: x = 'T')) AS n_slots FROM pieces2),
    filled AS MATERIALIZED (
      SELECT pattern, toks, [a] AS sizes FROM slotted, (SELECT unnest([1, 2]) AS a) WHERE n_slots = 1
      UNION ALL SELECT pattern, toks, [a, b] FROM slotted, (SELECT unnest([1, 2]) AS a), (SELECT unnest([1, 2]) AS b) WHERE n_slots = 2),
    walked AS (
      SELECT pattern, toks, sizes, list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(toks[1:i], lambda x: x = 'T'))) AS nth FROM filled),
    laid AS MATERIALIZED (
      SELECT pattern, toks, sizes, list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN toks[i] = 'T' THEN sizes[nth[i]] ELSE 1 END) AS wide,
        flatten(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN toks[i] = 'T' THEN list_transform(range(0, sizes[nth[i]]), lambda j: '*') ELSE [lower(toks[i])] END)) AS flat FROM walked),
    spans AS MATERIALIZED (
      SELECT pattern, toks, sizes, flat, i, list_sum(wide[1:i - 1]) AS lo, list_sum(wide[1:i]) AS hi, len(list_filter(toks[1:i], lambda x: x = 'T')) - 1 AS slot_no
      FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM laid) WHERE toks[i] = 'T')"""
MATCHED = """,
    places AS (
      SELECT s.doc_id, s.sent_id, l.pattern, l.sizes, l.flat, unnest(list_filter(range(0, greatest(0, len(words) - len(flat) + 1)),
        lambda p: len(list_filter(range(1, len(flat) + 1), lambda i: flat[i] <> '*' AND words[p + i] <> flat[i])) = 0)) AS pos, s.words
      FROM sents s, laid l),
    found AS MATERIALIZED (
      SELECT p.doc_id, p.sent_id, p.pos::BIGINT AS pos, p.pattern, x.slot_no::BIGINT AS slot_no,
        array_to_string(p.words[(p.pos + coalesce(x.lo, 0) + 1)::BIGINT:(p.pos + x.hi)::BIGINT], ' ') AS phrase, array_to_string(p.words[p.pos + 1:p.pos + len(p.flat)], ' ') AS context
      FROM places p JOIN spans x ON x.pattern = p.pattern AND x.sizes = p.sizes)"""
KNOWN = f", known AS (SELECT word AS term FROM tokens WHERE len(word) >= 3 AND word NOT IN ({quoted(STOP)}) GROUP BY word HAVING count(*) >= 20)"


def _extended(spark):
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, PATTERNS))).alias("pattern_no", "pattern"))
    return patterns.extend(rows)


def _filled(spark):
    lengths = spark.range(1).select(F.explode(F.array(*map(F.lit, SIZES))).alias("size"))
    return patterns.fill(_extended(spark).select("pattern").distinct(), lengths)


def _matches(spark, d):
    return patterns.matches(sents(spark, d), _filled(spark))


def _known(spark, d):
    counts = corpus.word_counts(sents(spark, d)).where((F.col("n") >= 20) & (F.length("word") >= 3) & ~F.col("word").isin(STOP))
    return counts.select(F.col("word").alias("term"))


def _from_items(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("pattern_no"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) >= 3")
    return patterns.extend(words.select("pattern_no", F.expr("concat('T? ', lower(w[0]), ' ', lower(w[1]), ' T ', lower(w[2]))").alias("pattern")))


def _filled_items(spark, d):
    return patterns.fill(_from_items(spark, d).select("pattern").distinct(), spark.range(1).select(F.explode(F.array(*map(F.lit, SIZES))).alias("size")))


@query("WITH " + FROM_ITEMS + " SELECT pattern_no, variant, pattern FROM extended")
def extend_patterns(spark, d):
    return _from_items(spark, d)


@query("WITH " + FROM_ITEMS + FILLED + " SELECT pattern, array_to_string(sizes, ' ') AS sizes, slot_no::BIGINT AS slot_no, coalesce(lo, 0)::BIGINT AS lo, hi::BIGINT AS hi FROM spans")
def fill_patterns(spark, d):
    rows = _filled_items(spark, d).select("pattern", F.array_join(F.transform("sizes", lambda x: x.cast("string")), " ").alias("sizes"), F.posexplode("spans").alias("slot_no", "s"))
    return rows.select("pattern", "sizes", F.col("slot_no").cast("long").alias("slot_no"), F.col("s.start").cast("long").alias("lo"), F.col("s.end").cast("long").alias("hi"))


@query("WITH " + FROM_ITEMS + FILLED + " SELECT pattern, count(*)::BIGINT AS n FROM filled GROUP BY pattern")
def filled_counts(spark, d):
    return _filled_items(spark, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(PRE + ", " + EXTENDED + FILLED + MATCHED + " SELECT doc_id, sent_id, pos, pattern, slot_no, phrase, context FROM found")
def match_patterns(spark, d):
    return _matches(spark, d)


@query(PRE + ", " + EXTENDED + FILLED + MATCHED + KNOWN + " SELECT k.term, count(*)::BIGINT AS n FROM found f JOIN known k ON k.term = f.phrase GROUP BY k.term HAVING count(*) >= 2")
def matched_term_counts(spark, d):
    return patterns.matched_terms(_matches(spark, d), _known(spark, d), 2)


@query(PRE + ", " + EXTENDED + FILLED + MATCHED + KNOWN + " SELECT pattern, count(*)::BIGINT AS n FROM found WHERE phrase IN (SELECT term FROM known) GROUP BY pattern")
def pattern_rank(spark, d):
    return patterns.pattern_ranks(_matches(spark, d), _known(spark, d))
