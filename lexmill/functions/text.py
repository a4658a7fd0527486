"""Column functions on strings. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must cut texts at the same places and into the same words as the results to match.
#: A sentence ends at a terminator before a capital, or at a blank line before a capitalised word.
#: The space comes first, so that most places are left after one comparison.
SENTENCE_BREAK = r"(?U)\s(?:(?<=[.!?]\s)\s*(?=[A-ZА-ЯЁ])|(?<=\n\s)\s*(?=[A-ZА-ЯЁ](?![A-ZА-ЯЁ])))"
WORD = r"(?U)[А-ЯЁа-яёA-Za-z]+(?:[-`']\w+)*"
#: The same with letters of every script.
WORD_UNICODE = r"(?U)\p{L}+(?:[-`']\w+)*"
EMAIL_LINE = r"(?im)^.*E-?mail\s*:?.*\n"


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def words(line: Column, letters: str = "reference") -> Column:
    """Lower-case words of a sentence; ``letters='unicode'`` keeps accented letters inside words."""
    found = F.regexp_extract_all(line, F.lit(WORD if letters == "reference" else WORD_UNICODE), F.lit(0))
    return F.transform(found, lambda w: F.lower(w))


def ngrams(tokens: Column, most: int, shortest: int = 2) -> Column:
    """All 1..``most``-grams of words with at least ``shortest`` letters, joined by spaces."""
    def grams(kept: Column) -> Column:
        def longer(held: Column, n: Column) -> Column:
            last = F.element_at(held, -1)  # the grams of one word less, but for the last of them, and the word after each
            more = F.zip_with(F.slice(last, F.lit(1), F.greatest(F.size(last) - 1, F.lit(0))), F.slice(kept, n, F.size(kept)), lambda gram, word: F.concat(gram, F.lit(" "), word))
            return F.concat(held, F.array(more))

        return kept if most < 2 else F.flatten(F.aggregate(F.sequence(F.lit(2), F.lit(most)), F.array(kept), longer))

    # the inner variable holds the kept words: without it they would be filtered again for every gram
    return F.flatten(F.transform(F.array(F.filter(tokens, lambda w: F.length(w) >= shortest)), grams))


def split_pattern(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\W+"), lambda x: x != "")


def normalize_pattern(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\W+", " "))


def validate_tag(tag: Column) -> Column:
    """The Cyrillic words of a tag; null for company blogs and for fewer than three characters."""
    kept = F.array_join(F.regexp_extract_all(tag, F.lit("(?iu)[а-яё]+"), F.lit(0)), " ")
    return F.when(F.lower(tag).contains("блог компании"), F.lit(None)).when(F.length(kept) >= 3, kept)


def filter_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, validate_tag), lambda x: x.isNotNull())


def simplify_name(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"(?U)\W+", " ")), r"\s+", "_")


def short_name(s: Column, size: int = 8, dot: bool = False) -> Column:
    cut = F.substring(s, 1, size)
    return F.when(F.length(s) > size, F.concat(cut, F.lit("."))).otherwise(cut) if dot else cut


def ranking_filename(short: Column, algorithms: Column, experts: Column) -> Column:
    return F.format_string("%s_%s-%s_RaED", short, F.array_join(algorithms, ""), F.array_join(experts, ""))


def fit_filename(name: Column, most: int = 60) -> Column:
    """A safe file name: no escapes, spaces as underscores, at most ``most`` characters with its extension."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "%[0-9A-Fa-f]{2}", ""), "[^0-9A-Za-zА-Яа-яЁё ._-]", ""), " ", "_")
    ending = F.regexp_extract(safe, r"(\.[0-9A-Za-z]{1,5})$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ending))
    return F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.length(ending)), ending)


def last_path_part(url: Column, full_url: bool = False) -> Column:
    return F.substring_index(F.parse_url(url, F.lit("PATH")) if full_url else url, "/", -1)


def hex_id(s: Column, size: int = 8) -> Column:
    return F.substring(F.md5(s.cast("binary")), 1, size)


def on_host(url: Column, host: Column | str) -> Column:
    """The URL if its host is ``host`` (case does not matter), else an empty string."""
    wanted = F.lit(host) if isinstance(host, str) else host
    return F.when(F.lower(F.parse_url(url, F.lit("HOST"))) == F.lower(wanted), url).otherwise("")


def starts_cyrillic(s: Column) -> Column:
    return s.rlike("(?iu)^[а-яё]")


def has_cyrillic(s: Column) -> Column:
    return s.rlike("(?iu)[а-яё]")


def positions(what: str, text: Column) -> Column:
    """All 0-based starts of ``what``, overlapping ones included."""
    pieces = F.split(text, "(?=" + re.escape(what) + ")")
    starts = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    )["out"]
    return F.filter(starts, lambda i: F.substring(text, i + 1, F.lit(len(what))) == F.lit(what))


def relative_position(what: str, text: Column) -> Column:
    """Where the first ``what`` is, as a share of the length; null without one."""
    at = F.locate(what, text)
    return F.when(at > 0, (at - 1) / F.length(text))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=.)-\n", "")


def join_paragraphs(paragraphs: Column) -> Column:
    """Paragraphs joined by line ends; one that ends in a hyphen runs into the next."""
    return F.aggregate(
        paragraphs, F.lit(""), lambda t, p: F.concat(t, F.when(p.endswith("-") & (F.length(p) > 1), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(F.concat(p, F.lit("\n"))))
    )


def cut_through(text: Column, what: Column) -> Column:
    """The text after the first occurrence of ``what`` (case does not matter), or all of it."""
    at = F.call_function("instr", F.lower(text), F.lower(what))
    return F.when((F.length(what) > 0) & (at > 0), F.substring(text, at + F.length(what), F.length(text))).otherwise(text)


def preview_meta(s: Column) -> tuple[Column, Column]:
    """Year and authors of ``2010 / A. Name, B. Name``."""
    year = F.regexp_extract(s, r"(\d+)\s*/\s*(.+)", 1)
    authors = F.transform(F.split(F.regexp_extract(s, r"(\d+)\s*/\s*(.+)", 2), ","), lambda a: F.trim(a))
    return F.when(year != "", year.cast("int")), authors


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def zone(start: Column, end: Column, size: Column) -> Column:
    """0 near the head (first tenth), 2 near the tail (last fifth), else 1."""
    return F.when(end / size <= 0.1, 0).when((size - start) / size <= 0.2, 2).otherwise(1)


def trim_once(text: Column, pattern: str) -> Column:
    """One step of zone trimming: what matches first is cut with the head, with the tail, or alone."""
    hit = F.regexp_extract(text, f"({pattern})", 1)
    at = F.call_function("instr", text, hit)
    end = at + F.length(hit) - 1
    where = zone(at - 1, end, F.length(text))
    head, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, end + 1, F.length(text))
    return F.when(hit == "", text).when(where == 0, tail).when(where == 2, head).otherwise(F.concat(head, tail))
