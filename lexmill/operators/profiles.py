"""Occurrence profiles on the word clock, burstiness and correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.rounds import settled


def raw_profile(sents: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """For each word and sentence the count at the sentence's clock; zeros included."""
    counts = F.transform(F.array(*map(F.lit, words)), lambda x: F.struct(x.alias("term"), F.size(F.filter("words", lambda w: w == x)).cast("long").alias("n")))
    t = F.sum("n_words").over(W.partitionBy(key).orderBy("sent_id").rowsBetween(W.unboundedPreceding, 0))
    return sents.withColumn("t", t).select(key, "sent_id", "t", F.explode(counts).alias("x")).select(key, "x.term", "t", "x.n")


def clock_ends(clocked: DataFrame, *keys: str) -> DataFrame:
    """t0 (clock after the first sentence), total words and number of sentences of each document."""
    return clocked.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("total"), F.count(F.lit(1)).alias("n_sentences"))


def ends_of(sents: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``clock_ends`` from sentences without a clock, which nobody has to put in order."""
    return sents.groupBy(*keys).agg(F.min_by("n_words", "sent_id").alias("t0"), F.sum("n_words").alias("total"), F.count(F.lit(1)).alias("n_sentences"))


def interval(total: Column, parts: Column) -> Column:
    return F.ceil(total / parts).cast("long")


def compressed(profile: DataFrame, ends: DataFrame, parts: int, key: str = "doc_id") -> DataFrame:
    """Sums by bin; bins start at t0, are ceil(total / parts) words wide, and empty ones are kept."""
    width = interval(F.col("total"), F.lit(parts))
    bins = profile.join(ends, key).withColumn("width", width).withColumn("bin", F.floor((F.col("t") - F.col("t0")) / F.col("width")).cast("long"))
    sums = bins.groupBy(key, "term", "bin").agg(F.sum("n").cast("long").alias("n"))
    grid = ends.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - F.col("t0")) / width).cast("long"))).alias("bin"))
    names = profile.select(key, "term").distinct()
    return grid.join(names, key).join(sums, [key, "term", "bin"], "left").select(key, "term", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def spread(s: Column, q: Column, bins: Column) -> Column:
    """Sample standard deviation of ``bins`` values from sum and sum of squares; null for one bin."""
    return F.when(bins > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / bins) / (bins - 1))))


def stdev_ranks(occurrences: DataFrame, clocked: DataFrame, parts: DataFrame, key: str = "doc_id", least: int = 1, ends: DataFrame | None = None) -> DataFrame:
    """Burstiness of terms: stddev of the binned profile times the number of words, for each value of parts.

    ``occurrences`` (key, sent_id, term, n_words, and the clock ``t`` if they carry it), ``clocked`` (key, sent_id, t),
    ``parts`` (key, parts), ``ends`` those of ``clocked`` if they are known. Terms with fewer than ``least`` occurrences are left out before anything is binned. A term's
    occurrences come together once, as their clocks, and give the sums of every value of parts; bins without any enter through their number.
    Occurrences taken from clocked sentences need no join with them, and stay where their document is.
    """
    at = occurrences if "t" in occurrences.columns else occurrences.join(clocked.select(key, "sent_id", "t"), [key, "sent_id"])
    setup = parts.join(clock_ends(clocked, key) if ends is None else ends, key).withColumn("width", interval(F.col("total"), F.col("parts")))
    setup = setup.select(key, "parts", "t0", "width", (F.floor((F.col("total") - F.col("t0")) / F.col("width")).cast("long") + 1).alias("bins"))
    per_term = at.groupBy(key, "term", "n_words").agg(F.collect_list("t").alias("ts")).where(F.size("ts") >= least)
    found = per_term.select(key, "term", "n_words", F.size("ts").cast("long").alias("n"), F.array_sort("ts").alias("ts")).join(setup, key)
    return found.select(key, "term", "n_words", "parts", "bins", "n", F.expr(_SQUARES).alias("q")).withColumn("score", spread(F.col("n").cast("double"), F.col("q").cast("double"), F.col("bins")) * F.col("n_words"))


#: The sum of the squares of the counts by bin, from rising clocks: the x-th of a bin adds x * x - (x - 1) * (x - 1).
_SQUARES = """
  aggregate(ts, named_struct('bin', -1L, 'x', 0L, 'q', 0L),
    (s, t) -> if((t - t0) div width = s.bin, named_struct('bin', s.bin, 'x', s.x + 1L, 'q', s.q + 2L * s.x + 1L), named_struct('bin', (t - t0) div width, 'x', 1L, 'q', s.q + 1L)),
    s -> s.q)"""


#: Terms of a side of a tile of pairs.
TILE = 128


def _vectors(bins: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row a term of a key: its number of bins, its sums, its bins with a value as a sparse vector, and how many tiles the key's terms fill."""
    n = F.col("n").cast("double")
    cells = F.collect_list(F.when(n != 0, F.struct("bin", n.alias("n"))))
    vectors = settled(bins.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("m"), F.sum(n).alias("x"), F.sum(n * n).alias("xx"), cells.alias("cells")))
    return _tiled(vectors, keys)


def _tiled(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    many = lambda count: F.ceil(count / F.lit(TILE)).cast("int")
    if not keys:
        return vectors.withColumn("tiles", many(F.lit(max(1, vectors.count()))))
    return vectors.join(vectors.groupBy(*keys).agg(many(F.count(F.lit(1))).alias("tiles")), list(keys))


def sparse_correlations(profile: DataFrame, ends: DataFrame, parts: int, key: str = "doc_id", least: int = 1) -> DataFrame:
    """The rows of ``correlations`` over ``compressed`` for terms with a sum of ``least`` or more, without cells for empty bins.

    ``profile``: key, term, t, n; ``ends``: those of the clock. The number of bins follows from the ends, and a
    term's cells come together where its text is.
    """
    width = interval(F.col("total"), F.lit(parts))
    setup = ends.select(key, "t0", width.alias("width"), (F.floor((F.col("total") - F.col("t0")) / width).cast("long") + 1).alias("m"))
    per_term = profile.groupBy(key, "term").agg(F.collect_list(F.struct("t", F.col("n").cast("double").alias("n"))).alias("at"), F.sum("n").alias("x")).where(F.col("x") >= least)
    cells = per_term.join(setup, key).select(key, "term", "m", F.inline(F.expr("transform(at, a -> struct(floor((a.t - t0) / width) as bin, a.n as n))")))
    sums = cells.groupBy(key, "term", "m", "bin").agg(F.sum("n").alias("n")).where("n <> 0")
    vectors = settled(sums.groupBy(key, "term", "m").agg(F.sum("n").alias("x"), F.sum(F.col("n") * F.col("n")).alias("xx"), F.collect_list(F.struct("bin", "n")).alias("cells")))
    return _correlated(_tiled(vectors, (key,)), (key,))


def _pairs(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every ordered pair of terms of a key, with both sides' sums and ``xy``, the sum of products over bins.

    Terms are dealt to tiles by hash; a tile of pairs is one key of the join, so a key with many terms is worked on by many
    tasks, and a pair meets once, as two vectors, not once a bin.
    """
    own, every = F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    a = vectors.select(*keys, F.col("term").alias("w1"), "m", "x", "xx", F.col("cells").alias("p"), own.alias("_a"), every.alias("_b"))
    b = vectors.select(*keys, F.col("term").alias("w2"), F.col("x").alias("y"), F.col("xx").alias("yy"), F.map_from_entries("cells").alias("q"), own.alias("_b"), every.alias("_a"))
    xy = F.aggregate("p", F.lit(0.0), lambda s, c: s + c["n"] * F.coalesce(F.try_element_at("q", c["bin"]), F.lit(0.0)))
    return a.join(b, [*keys, "_a", "_b"]).withColumn("xy", xy).drop("_a", "_b", "p", "q")


def cross_sums(bins: DataFrame, *keys: str) -> DataFrame:
    """keys, w1, w2 and xy: the sum over bins of the product of two terms' values, for every ordered pair of a key's terms."""
    return _pairs(_vectors(bins, keys), keys).select(*keys, "w1", "w2", "xy")


def correlations(bins: DataFrame, *keys: str) -> DataFrame:
    """Pearson correlation of each ordered pair of terms over a key's bins (keys, bin, term, n; a cell for each bin); null without variation."""
    return _correlated(_vectors(bins, keys), keys)


def _correlated(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    m, x, y = F.col("m"), F.col("x"), F.col("y")
    vx, vy = m * F.col("xx") - x * x, m * F.col("yy") - y * y
    return _pairs(vectors, keys).select(*keys, "w1", "w2", F.when((vx > 0) & (vy > 0), (m * F.col("xy") - x * y) / (F.sqrt(vx) * F.sqrt(vy))).alias("corr"))


def unit_profile(sents: DataFrame, members: DataFrame | Callable[[Column], Column], key: str = "doc_id") -> DataFrame:
    """Counts of units, families of words, at the clock of their sentences: key, term, t, n (no zeros).

    ``members``: word and term (the family's name), and the key if families differ from text to text; or a function that
    gives a word's term or null: then nothing is joined.
    ``sents`` carries the clock ``t``.
    """
    if callable(members):
        named = sents.select(key, "t", F.explode("words").alias("word")).select(key, "t", members(F.col("word")).alias("term")).where("term is not null")
        return named.groupBy(key, "term", "t").agg(F.count(F.lit(1)).alias("n"))
    counts = sents.select(key, "sent_id", "t", F.explode("words").alias("word")).groupBy(key, "sent_id", "t", "word").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(members.select(*[c for c in members.columns if c in (key, "word", "term")]), [c for c in members.columns if c in (key, "word")])
    return named.groupBy(key, "term", "t").agg(F.sum("n").cast("long").alias("n"))


def unit_occurrences(clocked: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences of units, lists of words and phrases that count as one: key, sent_id, term, n_words (1) and t, as rankings take them.

    ``units``: term (the unit's name) and words (array), a row a member.
    """
    from lexmill.operators import corpus, terms

    found = terms.phrase_occurrences(corpus.tokens(clocked, key), units.select(F.struct("term", "words").alias("term_id"), "words"), key)
    named = found.select(key, "sent_id", F.col("term_id.term").alias("term"), F.lit(1).cast("long").alias("n_words"))
    return named.join(clocked.select(key, "sent_id", "t"), [key, "sent_id"])


def zero_below(column: Column, least: float) -> Column:
    return F.when(column >= least, column).otherwise(0)


def frequent_columns(bins: DataFrame, part: int = 4, whole: int = 20, *keys: str) -> DataFrame:
    """Cells below ``part`` become 0; terms whose cells then sum to less than ``whole`` are dropped."""
    cut = bins.withColumn("n", zero_below(F.col("n"), part))
    kept = cut.groupBy(*keys, "term").agg(F.sum("n").alias("total")).where(F.col("total") >= whole)
    return cut.join(kept.select(*keys, "term"), [*keys, "term"], "left_semi")


def drop_uncorrelated(corr: DataFrame, threshold: float = 0.6, *keys: str) -> DataFrame:
    """Pairs above the threshold that are left when terms without a strong partner are struck out one after the other.

    The walk strikes a term out when no term that is left is correlated with it at the threshold or above; perfect
    correlations do not count. As correlation is mutual, a term with a strong partner is never struck out, whatever the
    order: the partner it has keeps it, and it keeps the partner. So the walk leaves the pairs above the threshold, and
    no matrix has to be in one place. Correlations are compared to nine digits.
    """
    return corr.where((F.col("w1") < F.col("w2")) & (F.round("corr", 9) > threshold) & (F.round("corr", 9) < 1))


def pair_statistics(corr: DataFrame) -> DataFrame:
    """Unordered pairs with a correlation."""
    return corr.where((F.col("w1") < F.col("w2")) & F.col("corr").isNotNull())
