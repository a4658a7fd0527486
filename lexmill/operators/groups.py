"""Noun groups as candidate terms, found by a finite-state chunker over a morphology table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of speech of heads and of modifiers.
NOUNS, MODIFIERS = ("NOUN",), ("ADJF", "PRTF")


def best_tags(morph: DataFrame) -> DataFrame:
    """word, pos, gcase and number of each word's likeliest hypothesis (highest ``score``, ties by lemma, pos, gcase and number)."""
    rank = F.struct(-F.coalesce(F.col("score"), F.lit(0.0)), "lemma", "pos", "gcase", "number")
    return morph.groupBy("word").agg(F.min_by(F.struct("pos", "gcase", "number"), rank).alias("t")).select("word", "t.*")


#: One step of the chunker. Phases: 0 nothing, 1 modifiers wait for their noun, 2 a group that may end here,
#: 3 such a group and modifiers that wait for a noun in the genitive. ``lo``/``hi``: the group, ``mark``: its first waiting modifier.
_EXTENDS = "(x.pos = s.next and ((s.phase in (1, 3) and x.gcase <=> s.gcase and x.number <=> s.number) or (s.phase = 2 and x.gcase = 'gent')))"
_STEP = """
  named_struct(
    'phase', if(x.noun, 2, if({ext} and s.phase >= 2, 3, 1)),
    'lo', if(x.noun, if({ext}, if(s.phase = 1, s.mark, s.lo), x.pos), s.lo),
    'hi', if(x.noun, x.pos + 1, s.hi),
    'mark', if(not x.noun and {ext} and s.phase <> 2, s.mark, x.pos),
    'gcase', x.gcase, 'number', x.number, 'next', x.pos + 1,
    'out', if(s.phase >= 2 and not {ext}, concat(s.out, array(named_struct('lo', s.lo, 'hi', s.hi))), s.out))""".format(ext=_EXTENDS)
_FOLD = f"""
  aggregate(tagged,
    named_struct('phase', 0, 'lo', 0, 'hi', 0, 'mark', 0, 'gcase', cast(null as string), 'number', cast(null as string), 'next', -1, 'out', cast(array() as array<struct<lo: int, hi: int>>)),
    (s, x) -> {_STEP},
    s -> if(s.phase >= 2, concat(s.out, array(named_struct('lo', s.lo, 'hi', s.hi))), s.out))"""


def noun_groups(sents: DataFrame, tags: DataFrame | Callable[[Column], Column], key: str = "doc_id", nested: bool = False, most: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of noun groups: key, sent_id, pos, term, n_words and inside (part of a longer group).

    A group is modifiers that agree with the noun after them in case and number, that noun, and any number of nouns in
    the genitive, each with modifiers that agree with it; groups are as long as they can be, from the left.
    ``tags``: one row a word (of ``best_tags``); other words end a group. Or a function that gives a word's pos, gcase and
    number as a struct: then sentences are tagged where they are, without a join, and keep the columns of ``carry``. With ``nested`` also the parts of a
    group that end in a noun, up to ``most`` words of them; whole groups have any length.
    """
    if callable(tags):
        found = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"), tags(w).alias("t")))
        found = F.filter(found, lambda x: x["t"]["pos"].isin(*NOUNS, *MODIFIERS))
        tag = lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), x["t"]["pos"].isin(*NOUNS).alias("noun"), x["t"]["gcase"].alias("gcase"), x["t"]["number"].alias("number"))
        tagged = sents.select(key, "sent_id", *carry, F.explode(F.array(F.transform(found, tag))).alias("tagged"))
    else:
        words = sents.select(key, "sent_id", *carry, F.posexplode("words").alias("pos", "word"))
        known = tags.where(F.col("pos").isin(*NOUNS, *MODIFIERS)).select("word", F.col("pos").isin(*NOUNS).alias("noun"), "gcase", "number")
        tagged = words.join(known, "word").groupBy(key, "sent_id", *carry).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "noun", "gcase", "number"))).alias("tagged"))
    runs = tagged.withColumn("run", F.explode(F.expr(_FOLD))).withColumn("w", F.filter("tagged", lambda x: (x["pos"] >= F.col("run.lo")) & (x["pos"] < F.col("run.hi"))))
    parts = F.array(F.struct(F.lit(0).alias("a"), F.size("w").alias("b")))
    if nested:
        inner = F.expr(f"""
          flatten(transform(sequence(1, size(w)), b -> if(w[b - 1].noun,
            transform(sequence(greatest(0, b - {int(most)}), b - 1), a -> named_struct('a', a, 'b', b)), cast(array() as array<struct<a: int, b: int>>))))""")
        parts = F.concat(parts, F.filter(inner, lambda p: (p["a"] > 0) | (p["b"] < F.size("w"))))
    rows = runs.select(key, "sent_id", *carry, "run", "w", F.explode(parts).alias("p"))
    inside = F.col("p.b") - F.col("p.a") < F.size("w")
    term = F.array_join(F.transform(F.slice("w", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), lambda x: x["word"]), " ")
    return rows.select(key, "sent_id", *carry, (F.col("run.lo") + F.col("p.a")).cast("long").alias("pos"), term.alias("term"), (F.col("p.b") - F.col("p.a")).cast("long").alias("n_words"), inside.alias("inside"))


def nested_counts(groups: DataFrame, *keys: str) -> DataFrame:
    """keys, term, n_words, n (all occurrences) and alone (those that are no part of a longer group)."""
    return groups.groupBy(*keys, "term", "n_words").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("inside")).cast("long")).alias("alone"))
