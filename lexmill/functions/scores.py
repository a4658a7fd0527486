"""Column functions on numbers, and word distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r <= 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def term_score(count: Column, pos: Column, number: Column, animacy: Column, case: Column, flags: Column) -> Column:
    """How likely a hypothesis is the head of a term; -1 for Latin, punctuation, numbers and unknown words."""
    weight = (
        F.when(pos.isin("NOUN", "ADJF", "PRTF"), 1).otherwise(0)
        * F.when(number == "sing", 5).otherwise(1)
        * F.when(animacy == "inan", F.lit(5.0)).otherwise(0.75)
        * F.when(case == "nomn", 2).otherwise(1)
    )
    return F.when(F.arrays_overlap(flags, F.array(*map(F.lit, ("LATN", "PNCT", "NUMB", "UNKN")))), F.lit(-1.0)).otherwise(F.log1p(count) * weight)


def word_distance(a: str, b: str) -> Column:
    """Sliding Levenshtein distance of two word columns; related words have at most 1."""
    return F.expr(f"""
      transform(array(if(length({a}) <= length({b}), named_struct('s', {a}, 'l', {b}), named_struct('s', {b}, 'l', {a}))), p ->
        if(length(p.s) < 3 or length(p.l) > length(p.s) + 4 or length(p.l) > 2 * length(p.s), cast(length(p.l) as double),
           array_min(transform(sequence(1, length(p.l) - length(p.s) + 1), i -> levenshtein(p.s, substring(p.l, i, length(p.s))))) / (least(8, length(p.s)) / 3.0D)))[0]""")


def parts_of(parts: Column | int, sentences: Column, total: Column) -> Column:
    """A document's share of ``parts``, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(parts) * sentences / total).cast("int"))


def chapter_score(n: Column, word_total: Column, chapters: Column, words: Column, words_total: Column) -> Column:
    return n / word_total * chapters * words / words_total * chapters
