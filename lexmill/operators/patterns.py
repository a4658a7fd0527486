"""Definition patterns: lexical templates with term slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import lemmas
from lexmill.operators.rounds import BROADCAST_ROWS, settled

SLOT = r"\b(?:Т|T)\b"


def extend(patterns: DataFrame) -> DataFrame:
    """Each optional slot ``T?`` is kept or left out, and at least one slot remains.

    Columns: pattern_no, variant (bit i set: the i-th optional slot is kept) and pattern.
    """
    plain = F.regexp_replace("pattern", "(?U)" + SLOT, "T")
    rows = patterns.select("pattern_no", F.split(plain, r"T\?").alias("parts"))
    rows = rows.withColumn("optional", F.size("parts") - 1).withColumn("fixed", F.exists("parts", lambda p: p.rlike(r"\bT\b")))
    rows = rows.withColumn("variant", F.explode(F.expr("sequence(0L, shiftleft(1L, optional) - 1L)"))).where("variant > 0 or fixed")
    joined = F.expr("aggregate(sequence(0, optional), '', (t, i) -> concat(t, parts[i], if(i < optional and (shiftright(variant, i) & 1) = 1, 'T', '')))")
    return rows.select("pattern_no", "variant", F.trim(F.regexp_replace(joined, r" {2,}", " ")).alias("pattern"))


def tokens(pattern: Column) -> Column:
    return F.filter(F.split(pattern, r"(?U)\W+"), lambda x: x != "")


def slots(pattern: Column) -> Column:
    return F.size(F.filter(tokens(pattern), lambda x: x == "T"))


def super_terms(terms: DataFrame) -> DataFrame:
    """Super-terms: size, pos and lemma of what may stand at each position of a term of each length. ``terms``: words and lemmas.

    They stay rows, as many as there are; ``lemmas.fitting`` meets them by a join.
    """
    at = terms.select(F.size("words").alias("size"), F.posexplode("lemmas").alias("pos", "ls"))
    return at.select("size", "pos", F.explode("ls").alias("lemma")).distinct()


def length_tuples(lengths: DataFrame, k: int) -> DataFrame:
    """All ordered k-tuples of the distinct lengths; the first one varies slowest."""
    if k < 1:
        raise ValueError("k must be positive")
    found = lengths.select(F.array("size").alias("sizes"))
    one = lengths.select("size")
    for _ in range(k - 1):
        found = found.join(F.broadcast(one)).select(F.concat("sizes", F.array("size")).alias("sizes"))  # distinct term lengths are few
    return found


def fill(patterns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Patterns times lengths of their slots, however many: pattern, sizes, n_tokens and the [start, end) spans of the slots."""
    base = patterns.select("pattern", tokens(F.col("pattern")).alias("tokens")).withColumn("n_slots", F.size(F.filter("tokens", lambda x: x == "T")))
    rows = None
    for k in sorted(r.n_slots for r in base.where("n_slots > 0").select("n_slots").distinct().collect()):  # a few numbers
        part = base.where(F.col("n_slots") == k).join(length_tuples(lengths, k))  # lengths ** slots rows a pattern
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = base.limit(0).withColumn("sizes", F.array().cast("array<int>"))
    walk = F.expr("""
      aggregate(tokens, named_struct('at', 0, 'slot', 0, 'spans', cast(array() as array<struct<start: int, end: int>>)),
        (s, x) -> if(x = 'T',
          named_struct('at', s.at + sizes[s.slot], 'slot', s.slot + 1, 'spans', concat(s.spans, array(named_struct('start', s.at, 'end', s.at + sizes[s.slot])))),
          named_struct('at', s.at + 1, 'slot', s.slot, 'spans', s.spans)))""")
    return rows.withColumn("w", walk).select("pattern", "sizes", F.col("w.at").alias("n_tokens"), F.col("w.spans").alias("spans"), "tokens")


def laid_out(filled: DataFrame) -> DataFrame:
    """``filled`` with ``flat``: the literal word at each place, null inside slots."""
    flat = F.expr("""
      aggregate(tokens, named_struct('slot', 0, 'out', cast(array() as array<string>)),
        (s, x) -> if(x = 'T', named_struct('slot', s.slot + 1, 'out', concat(s.out, array_repeat(cast(null as string), sizes[s.slot]))),
                              named_struct('slot', s.slot, 'out', concat(s.out, array(lower(x))))), s -> s.out)""")
    return filled.withColumn("flat", flat)


def slot_rows(hit: DataFrame, key: str = "doc_id", supers: DataFrame | None = None, morph: DataFrame | None = None) -> DataFrame:
    """A row a slot of each place (key, sent_id, start, pattern, spans, and its words ``here``).

    With ``supers`` (of ``super_terms``) and ``morph`` only places each of whose slots holds words with lemmas
    of the super-term of that length.
    """
    hit = hit.select(key, "sent_id", F.col("start").cast("long").alias("pos"), "pattern", "spans", "here", F.posexplode("spans").alias("slot_no", "span"))
    phrase = F.array_join(F.slice("here", F.col("span.start") + 1, F.col("span.end") - F.col("span.start")), " ")
    slotted = hit.select(key, "sent_id", "pos", "pattern", "spans", F.col("slot_no").cast("long").alias("slot_no"), phrase.alias("phrase"), F.array_join("here", " ").alias("context"))
    if supers is not None:
        fit = lemmas.fitting(slotted.select("phrase"), supers, morph).withColumn("fits", F.lit(1))
        whole = F.count("fits").over(W.partitionBy(key, "sent_id", "pos", "pattern", "spans"))
        slotted = slotted.join(fit, "phrase", "left").withColumn("whole", whole).where(F.col("whole") == F.size("spans"))
    return slotted.select(key, "sent_id", "pos", "pattern", "slot_no", "phrase", "context")


def matches(sents: DataFrame, filled: DataFrame, key: str = "doc_id", supers: DataFrame | None = None, morph: DataFrame | None = None) -> DataFrame:
    """Places where a filled pattern's literal words match: key, sent_id, pos, pattern, slot_no, phrase, context.

    Words meet patterns by their first literal word. Patterns that are few are broadcast and meet the words where
    their sentence is; else an equi-join on word places alone, and sentences with such a place then give their words. The whole stretch is compared. A slot takes any words; see
    ``slot_rows`` for ``supers`` and ``morph``, and ``lemma_index.matches`` for literals by lemma.
    """
    lit_at = F.expr("filter(transform(flat, (x, i) -> struct(i as i, x as x)), p -> p.x is not null)")
    wanted = laid_out(filled).withColumn("fixed", lit_at).where("size(fixed) > 0")
    wanted = wanted.select("pattern", "spans", "n_tokens", "flat", F.col("fixed")[0]["i"].alias("shift"), F.col("fixed")[0]["x"].alias("word"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = sents.select(key, "sent_id", "n_words", F.posexplode("words").alias("pos", "word"))
    begins = lambda rows: rows.withColumn("start", F.col("pos") - F.col("shift")).where("start >= 0 and start + n_tokens <= n_words")
    if few:
        near = begins(sents.select(key, "sent_id", "n_words", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(wanted), "word"))
    else:
        near = begins(words.join(wanted, "word")).drop("word", "pos", "n_words").join(sents.select(key, "sent_id", "words"), [key, "sent_id"])
    hit = near.withColumn("here", F.slice("words", F.col("start") + 1, F.col("n_tokens"))).where(F.forall(F.zip_with("here", "flat", lambda a, b: b.isNull() | (a == b)), lambda x: x))
    return slot_rows(hit, key, supers, morph)


def templates(patterns: DataFrame, morph: DataFrame) -> DataFrame:
    """Parts of each pattern: pattern, part_no, is_slot, words, and the lemmas of a literal part by place.

    A slot is a part of its own; the literal words between two slots are one.
    """
    placed = patterns.select("pattern").distinct().withColumn("tokens", tokens(F.col("pattern")))
    # a word begins a part if it is a slot, comes after one, or is the first
    starts = F.expr("transform(tokens, (x, i) -> if(i = 0 or x = 'T' or tokens[i - 1] = 'T', 1L, 0L))")
    nth = F.expr("transform(starts, (x, i) -> aggregate(slice(starts, 1, i + 1), 0L, (a, b) -> a + b) - 1)")
    rows = placed.withColumn("starts", starts).withColumn("nth", nth).select("pattern", F.posexplode(F.arrays_zip(F.col("tokens").alias("w"), F.col("nth").alias("part_no"))).alias("at", "x"))
    rows = rows.select("pattern", "at", F.col("x.part_no").alias("part_no"), (F.col("x.w") == "T").alias("is_slot"), F.col("x.w").alias("w"), F.lower("x.w").alias("word"))
    known = rows.where("not is_slot").select("word").distinct().join(morph.select("word", F.col("lemma").alias("_lemma")).distinct(), "word", "left")
    known = known.groupBy("word").agg(F.array_sort(F.collect_set(F.coalesce("_lemma", "word"))).alias("lemmas"))
    rows = rows.join(known, "word", "left").withColumn("lemmas", F.when(~F.col("is_slot"), F.col("lemmas")))
    parts = rows.groupBy("pattern", "part_no", "is_slot").agg(F.array_sort(F.collect_list(F.struct("at", "w", "lemmas"))).alias("x"))
    return parts.select("pattern", "part_no", "is_slot", F.transform("x", lambda x: x["w"]).alias("words"), F.when(~F.col("is_slot"), F.transform("x", lambda x: x["lemmas"])).alias("lemmas"))


def matched_terms(found: DataFrame, terms: DataFrame, least: int = 1, morph: DataFrame | None = None) -> DataFrame:
    """How often each known term (term) fills a slot, as it is or, with ``morph``, by its lemma pattern."""
    counts = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    counts = counts if morph is None else settled(counts)
    pairs = terms.select("term", F.col("term").alias("phrase")).distinct() if morph is None else lemmas.same_lemmas(counts.select("phrase"), terms.select("term"), morph)
    return counts.join(pairs, "phrase").groupBy("term").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)


def pattern_ranks(found: DataFrame, terms: DataFrame, morph: DataFrame | None = None) -> DataFrame:
    """Matches by pattern, all slot lengths together, among those whose slot holds a known term (by lemmas with ``morph``)."""
    counts = found.groupBy("pattern", "phrase").agg(F.count(F.lit(1)).alias("n"))
    counts = counts if morph is None else settled(counts)
    wanted = terms.select(F.col("term").alias("phrase")) if morph is None else lemmas.same_lemmas(counts.select("phrase").distinct(), terms.select("term"), morph).select("phrase")
    known = counts.join(wanted.distinct(), "phrase", "left_semi")
    return known.groupBy("pattern").agg(F.sum("n").alias("n"))
