"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent: w = p**a / sum(p**a). The exponent is bisected in
[0, 1], 1 keeping the shares and 0 making all sources equal, until the most repeated source stays
within a repetition limit, or the entropy of w reaches a target. The budget is what uses every
source whole at least once (or a given number of tokens). Each source's quota is then realised in
epochs: whole passes, then a part of a pass. A pass takes hash-dealt blocks of about
``block_docs`` documents in hashed order, and the documents of a block in hashed order, so all
sums run inside blocks or over one row a block.

Defined cases: a null source is the source ``(none)``; null and empty texts have no tokens and are
used once in each pass their source gets; a source without any token gets one pass; repeated ids
keep their place together; other columns may have any names and come back unchanged; an empty table
gives an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import small, stash

WORD = "[^\\x20\\x09-\\x0D]+"
STEPS = 60


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("(none)"))


def _tokens() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _order(seed: int, epoch: Column, *what: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), *[x.cast("string") for x in what]).cast("binary"))


def _deal(seed: int, blocks: Column) -> Column:
    """The block of a document: a hash of its id modulo the number of blocks of its source."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit("block"), _id()).cast("binary")), 1, 12), 16, 10).cast("long") % blocks).cast("int")


def weights(sources: DataFrame, repetitions: float | None, entropy: float | None, budget: int | None, block_docs: int) -> DataFrame:
    """Per source: share, weight, quota, whole passes, rest of the quota, and number of blocks.

    ``sources`` has one row a source; they meet in one array for the bisection.
    """
    shares = sources.agg(
        F.array_sort(F.collect_list(F.struct("source", "tokens", "docs"))).alias("s"), F.sum("tokens").cast("double").alias("total")
    ).withColumn("p", F.expr("transform(filter(s, x -> x.tokens > 0), x -> x.tokens / total)"))
    tempered = "transform(p, x -> power(x, {a}))"
    total = "aggregate({v}, 0D, (t, x) -> t + x)"
    if entropy is not None:
        powered = tempered.format(a="m")
        norm = total.format(v=powered)
        # sum of -w log2 w with w = v / norm is log2(norm) - sum(v log2 v) / norm
        enough = f"log2({norm}) - aggregate({powered}, 0D, (t, x) -> t + x * log2(x)) / ({norm}) >= {float(entropy)!r}D"
        step = f"if({{test}}, named_struct('lo', m, 'hi', b.hi), named_struct('lo', b.lo, 'hi', m))".format(test=enough)
        pick = "b.lo"
    else:
        fits = f"power(array_max(p) / array_min(p), 1D - m) <= {float(repetitions)!r}D"
        if budget is not None:
            fits = f"array_max(transform(p, x -> power(x, m - 1D))) / ({total.format(v=tempered.format(a='m'))}) * {int(budget)}D / total <= {float(repetitions)!r}D"
        step = f"if({fits}, named_struct('lo', b.lo, 'hi', m), named_struct('lo', m, 'hi', b.hi))"
        pick = "b.hi"
    bisected = f"""aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D),
        (b, i) -> element_at(transform(array((b.lo + b.hi) / 2D), m -> {step}), 1), b -> {pick})"""
    one = shares.withColumn("exponent", F.expr(f"if(size(p) = 0, 1D, {bisected})")).withColumn("norm", F.expr(total.format(v=tempered.format(a="exponent"))))
    rows = one.select(F.explode("s").alias("x"), "total", "exponent", "norm", "p").select("x.*", "total", "exponent", "norm", "p")
    weight = F.when(F.col("tokens") > 0, F.expr("power(tokens / total, exponent) / norm")).otherwise(F.lit(0.0))
    spend = F.lit(float(budget)) if budget is not None else F.expr("array_max(transform(p, x -> power(x, 1D - exponent))) * norm * total")
    rows = rows.withColumn("weight", weight).withColumn("quota", F.when(F.col("tokens") > 0, F.round(F.col("weight") * spend).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "source", "tokens", "docs", "exponent", "weight", "quota",
        F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("int").alias("passes"),
        F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
        F.ceil(F.col("docs") / F.lit(block_docs)).cast("int").alias("blocks"),
    )


def schedule(docs: DataFrame, repetitions: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_docs: int = 1000, seed: int = 7) -> DataFrame:
    """One row a use of a document: source, epoch, block, doc_id, n_tokens, and the source's tokens before it in that epoch."""
    rows = stash(docs.select(_source().alias("source"), "doc_id", _tokens().alias("n_tokens"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = small(stash(weights(sources, repetitions, entropy, budget, block_docs), "mix-weights"), 10_000)
    epoch = F.col("epoch")
    used = (
        rows.join(plan.select("source", "passes", "rest", "blocks"), "source")
        .withColumn("block", _deal(seed, F.col("blocks")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1))))
        .where("passes > 0 or rest > 0")
        .withColumn("block_order", _order(seed, epoch, F.col("source"), F.col("block")))
        .withColumn("doc_order", _order(seed, epoch, _id()))
        .select("source", "epoch", "block", "doc_id", "n_tokens", "crc", "block_order", "doc_order", F.when(epoch < F.col("passes"), F.lit(None)).otherwise(F.col("rest")).alias("most"))
    )
    blocks = used.groupBy("source", "epoch", "block_order").agg(F.sum("n_tokens").alias("block_tokens"))
    before = W.partitionBy("source", "epoch").orderBy("block_order")
    blocks = blocks.select("source", "epoch", "block_order", (F.sum("block_tokens").over(before) - F.col("block_tokens")).alias("block_start"))
    inside = W.partitionBy("source", "epoch", "block_order").orderBy("doc_order", "doc_id", "n_tokens", "crc").rowsBetween(W.unboundedPreceding, 0)
    used = used.withColumn("in_block", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(blocks, ["source", "epoch", "block_order"])
    used = used.withColumn("token_start", F.col("block_start") + F.col("in_block"))
    return used.where("most is null or token_start < most").select(
        "source", "epoch", "block", "doc_id", "n_tokens", "token_start", "block_order", "doc_order", F.col("most").isNotNull().alias("partial"), F.lit(seed).alias("seed")
    )


def _free(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def mix(docs: DataFrame, repetitions: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_docs: int = 1000, seed: int = 7) -> DataFrame:
    """The documents of the schedule, each as often as it is used, with the columns of ``docs``.

    Texts are not shuffled: the part of a pass that a source gets ends at one point of its block
    permutation, so each row decides by itself, against one row a source, how often it is used.
    """
    planned = stash(schedule(docs, repetitions, entropy, budget, block_docs, seed), "mix-schedule")
    cuts = planned.groupBy("source").agg(
        F.max(F.when(F.col("partial"), F.struct("block_order", "doc_order"))).alias("cut"),
        F.max(F.when(F.col("partial"), F.col("epoch"))).alias("cut_epoch"),
        F.coalesce(F.max(F.when(~F.col("partial"), F.col("epoch"))) + 1, F.lit(0)).alias("whole"),
    )
    counts = docs.select(_source().alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    cuts = cuts.join(counts.select("source", F.ceil(F.col("docs") / F.lit(block_docs)).cast("int").alias("blocks")), "source")
    mine, times, use = (_free(docs.columns, name) for name in ("mix", "times", "use"))
    cuts = stash(cuts, "mix-cuts").select(F.struct("source", "cut", "cut_epoch", "whole", "blocks").alias(mine))
    joined = docs.join(small(cuts, 10_000), _source() == F.col(f"{mine}.source"))
    epoch, block = F.col(f"{mine}.cut_epoch"), _deal(seed, F.col(f"{mine}.blocks"))
    here = F.struct(_order(seed, epoch, _source(), block).alias("block_order"), _order(seed, epoch, _id()).alias("doc_order"))
    n = F.col(f"{mine}.whole") + F.when(F.col(f"{mine}.cut").isNotNull() & (here <= F.col(f"{mine}.cut")), 1).otherwise(0)
    used = joined.withColumn(times, n).where(F.col(times) > 0).withColumn(use, F.explode(F.sequence(F.lit(1), F.col(times))))
    return used.select(*[F.col(f"`{c}`") for c in docs.columns])


def schedule_sql(repetitions: float = 2.0, block_docs: int = 1000, seed: int = 7) -> str:
    """The schedule in DuckDB SQL over ``{docs}``, for a repetition limit and the covering budget."""
    return f"""
    WITH RECURSIVE mixed_rows AS MATERIALIZED (
      SELECT coalesce(source, '(none)') AS source, doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
      FROM {{docs}}),
    sources AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM mixed_rows GROUP BY source),
    shares AS (SELECT max(tokens / t) AS hi_p, min(tokens / t) AS lo_p FROM sources, (SELECT sum(tokens)::DOUBLE AS t FROM sources) WHERE tokens > 0),
    bisect(i, lo, hi) AS (
      SELECT 0, 0::DOUBLE, 1::DOUBLE
      UNION ALL
      SELECT i + 1, CASE WHEN pow(hi_p / lo_p, 1 - (lo + hi) / 2) <= {float(repetitions)!r} THEN lo ELSE (lo + hi) / 2 END,
             CASE WHEN pow(hi_p / lo_p, 1 - (lo + hi) / 2) <= {float(repetitions)!r} THEN (lo + hi) / 2 ELSE hi END
      FROM bisect, shares WHERE i < {STEPS}),
    tempered AS MATERIALIZED (
      SELECT s.*, t.t, pow(s.tokens / t.t, b.hi) AS v, b.hi AS a FROM sources s, (SELECT sum(tokens)::DOUBLE AS t FROM sources) t, (SELECT hi FROM bisect WHERE i = {STEPS}) b),
    quotas AS MATERIALIZED (
      SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN round(v / n.norm * (n.most * n.norm * t))::BIGINT ELSE 0 END AS quota
      FROM tempered, (SELECT sum(v) FILTER (tokens > 0) AS norm, max(pow(tokens / t, 1 - a)) FILTER (tokens > 0) AS most FROM tempered) n),
    plan AS MATERIALIZED (
      SELECT source, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest,
             ceil(docs / {block_docs})::INT AS blocks FROM quotas),
    used AS MATERIALIZED (
      SELECT r.source, e.epoch::INT AS epoch, (('0x' || substr(md5('{seed}|block|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % blocks)::INT AS block, doc_id, n_tokens,
             md5('{seed}|' || e.epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS doc_order,
             CASE WHEN e.epoch < passes THEN NULL ELSE rest END AS most
      FROM mixed_rows r JOIN plan p ON r.source = p.source, LATERAL (SELECT unnest(range(0, CASE WHEN rest > 0 THEN passes + 1 ELSE passes END)) AS epoch) e),
    placed AS (
      SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('{seed}|' || epoch || '|' || source || '|' || block), doc_order, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS token_start
      FROM used)
    SELECT source, epoch, block, doc_id, n_tokens, token_start::BIGINT AS token_start FROM placed WHERE most IS NULL OR token_start < most"""
