"""Article records: ranges of missing numbers, preview back-fill, stored keys, and similar articles."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import EMAIL_LINE, filter_tags
from lexmill.operators import scans
from lexmill.operators.rounds import settled, small


def number_gaps(rows: DataFrame, *keys: str) -> DataFrame:
    """Missing numbers before each present one, and the open range after the last: lo, hi (null: open).

    Without keys, or with a key that has most rows, no task takes all numbers (``scans.gaps``).
    """
    return scans.gaps(rows.select(*keys, "number").where("number is not null").distinct(), list(keys)).unionByName(_open_end(rows, *keys))


def _open_end(rows: DataFrame, *keys: str) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max("number").alias("m")) if keys else rows.agg(F.max("number").alias("m"))
    return last.where("m is not null").select(*keys, (F.col("m") + 1).alias("lo"), F.lit(None).cast("long").alias("hi"))


def unsaved_islands(rows: DataFrame, *keys: str) -> DataFrame:
    """Runs of consecutive unsaved numbers (columns number, saved), and the open range after the last."""
    runs = scans.islands(rows.select(*keys, "number", (~F.col("saved")).alias("unsaved")), list(keys), "unsaved")
    return runs.unionByName(_open_end(rows, *keys))


#: Bins that numbers are dealt to, unless there are more ranges.
BINS = 1 << 16


def in_ranges(rows: DataFrame, ranges: DataFrame, column: str = "number") -> DataFrame:
    """Rows whose number is in a range lo..hi (hi null: open), however many ranges there are; without ranges all rows.

    Ranges are merged and cut at the borders of bins; rows meet the pieces of their bin and are compared with them.
    """
    if ranges.isEmpty():
        return rows
    whole = scans.merged(ranges)
    least, most, n = (*rows.agg(F.min(column), F.max(column)).first(), whole.count())
    if least is None:
        return rows.limit(0)
    width = max(1, (most - least + 1) // max(BINS, n))
    bin_of = lambda c: F.floor((c - F.lit(least)) / F.lit(width))
    cut = whole.select(F.greatest("lo", F.lit(least)).alias("lo"), F.least(F.coalesce("hi", F.lit(most)), F.lit(most)).alias("hi")).where("lo <= hi")
    pieces = cut.select("lo", "hi", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))).alias("_bin"))
    dealt = rows.withColumn("_bin", bin_of(F.col(column)))
    return dealt.join(pieces, (dealt["_bin"] == pieces["_bin"]) & (F.col(column) >= F.col("lo")) & (F.col(column) <= F.col("hi")), "left_semi").drop("_bin")


def pages_to_load(pages: DataFrame, ranges: DataFrame, size: int = 20, limit: int | None = None) -> DataFrame:
    """Pages (page_no from 1) with an item that is in a range and within the limit."""
    items = pages.select("page_no", F.explode(F.sequence((F.col("page_no") - 1) * size + 1, F.col("page_no") * size)).alias("number"))
    if limit is not None:
        items = items.where(F.col("number") <= limit)
    return in_ranges(items, ranges).select("page_no").distinct()


def back_fill(articles: DataFrame, previews: DataFrame, always: list[str], if_empty: list[str], key: str = "number") -> DataFrame:
    """Previews give the ``always`` columns, and the ``if_empty`` ones where the article's is null or empty."""
    p = previews.select(key, *[F.col(c).alias(f"_p_{c}") for c in [*always, *if_empty]])
    joined = articles.join(p, key, "left")
    for c in always:
        joined = joined.withColumn(c, F.coalesce(f"_p_{c}", c))
    for c in if_empty:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_p_{c}")))
    return joined.select(*articles.columns)


def not_stored(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def first_visits(requests: DataFrame, articles: DataFrame, key: str = "number") -> DataFrame:
    """Requested articles, each once."""
    return articles.join(requests.select(key).distinct(), key, "left_semi")


def from_number(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """``limit`` rows in number order from the one numbered ``start``; none if there is no such row."""
    there = rows.where(F.col("number") == start).select(F.lit(1).alias("_there")).limit(1)
    return rows.where(F.col("number") >= start).join(F.broadcast(there)).drop("_there").orderBy("number").limit(limit)


def similar(articles: DataFrame, edges: DataFrame, seeds: DataFrame, accept: Column, need: int, rounds: int | None = None) -> DataFrame:
    """Articles reached from the seeds over edges (src, dst), breadth first: node and round.

    Only accepted articles are kept and walked on from; visited ones are not visited again. Stops
    when ``need`` articles are found, when a round finds none, or after ``rounds``. Each round is one
    join of the frontier.
    """
    ok = articles.where(accept).select("node")
    found = seeds.select("node").distinct().withColumn("round", F.lit(0))
    frontier = found
    for i in itertools.count(1) if rounds is None else range(1, rounds + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = settled(reached.join(ok, "node", "left_semi").join(found.select("node"), "node", "left_anti").withColumn("round", F.lit(i)))
        found = found.unionByName(frontier)
        if found.limit(need).count() >= need or frontier.isEmpty():
            break
    return found


def similar_by_authors(articles: DataFrame, seeds: DataFrame, accept: Column, need: int, rounds: int | None = None) -> DataFrame:
    """Articles reached from the seeds through shared authors of one topic, breadth first: node and round.

    ``articles``: node, topic, authors. The walk goes over the two-sided graph of articles and (topic, author)
    pairs: the frontier's authors that were not walked before, then their articles that were not, so pairs of articles
    of one author are never built and an author is left once. Only accepted articles are kept and walked on from.
    Stops as ``similar`` does, with ``need`` articles or an empty round.
    """
    sides = settled(articles.select("node", "topic", F.explode(F.array_distinct(F.transform("authors", lambda a: F.trim(a)))).alias("author")))
    ok = articles.where(accept).select("node").distinct()
    found = seeds.select("node").distinct().withColumn("round", F.lit(0))
    frontier, walked = found, None
    for i in itertools.count(1) if rounds is None else range(1, rounds + 1):
        names = sides.join(frontier.select("node"), "node", "left_semi").select("topic", "author").distinct()
        if walked is not None:
            names = names.join(walked, ["topic", "author"], "left_anti")
        names = settled(names)
        walked = names if walked is None else walked.unionByName(names)
        reached = sides.join(names, ["topic", "author"], "left_semi").select("node").distinct()
        frontier = settled(reached.join(ok, "node", "left_semi").join(found.select("node"), "node", "left_anti").withColumn("round", F.lit(i)))
        found = found.unionByName(frontier)
        if found.limit(need).count() >= need or frontier.isEmpty():
            break
    return found


def author_edges(articles: DataFrame) -> DataFrame:
    """Articles of one topic that share an author, as classes: node, topic, author, class_id and n_links.

    A row an article and author. Two articles are linked if they have rows with the same topic and author; such rows are a
    class, named by its smallest article, and each is linked with all others of it. Pairs, whose number grows with the
    square of an author's articles, are never built. Without a topic or an author an article is alone.
    """
    rows = settled(articles.select("node", "topic", F.explode_outer(F.transform("authors", lambda a: F.trim(a))).alias("author")).distinct())
    classes = settled(rows.where("topic is not null and author is not null").groupBy("topic", "author").agg(F.min("node").alias("class_id"), (F.count("node") - 1).alias("n_links")))
    found = rows.join(small(classes), ["topic", "author"], "left")
    return found.select("node", "topic", "author", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: Members of a class that meet as many others in one step of ``author_pairs``.
MEMBERS = 1 << 12


def author_pairs(articles: DataFrame) -> DataFrame:
    """All pairs of articles of one topic that share an author, in both directions and once each: src, dst.

    The number of pairs grows with the square of an author's articles, so none is shuffled or held: the articles of a
    (topic, author) are dealt to blocks, two blocks meet in one task, and a pair that shares several authors comes from the first of them only.
    """
    sides = F.explode(F.transform("authors", lambda a: F.struct(F.col("topic").alias("topic"), F.trim(a).alias("author")))).alias("side")
    sides = articles.select("node", sides).where("side.topic is not null and side.author is not null")
    held = sides.groupBy("node").agg(F.array_sort(F.collect_set("side")).alias("sides"))
    rows = settled(held.select("node", F.when(F.size("sides") > 1, F.col("sides")).alias("sides"), F.explode("sides").alias("side")))
    sizes = settled(rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / MEMBERS)))
    tasks = sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 1
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(4 * tasks, 1 << 12))
    placed = rows.join(small(sizes.select("side", "blocks")), "side").withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
    others = F.explode(F.expr("sequence(0L, blocks - 1)"))
    left = placed.select("side", F.col("own").alias("a"), others.alias("b"), F.col("node").alias("src"), F.col("sides").alias("mine")).repartition(tasks, "side", "a", "b")
    right = placed.select("side", others.alias("a"), F.col("own").alias("b"), F.col("node").alias("dst"), F.col("sides").alias("theirs")).repartition(tasks, "side", "a", "b")
    first = "mine is null or theirs is null or side = array_min(array_intersect(mine, theirs))"
    return left.join(right.hint("merge"), ["side", "a", "b"]).where("src <> dst").where(first).select("src", "dst")


def literature(paragraphs: DataFrame, heading: str, key: str = "doc_id") -> DataFrame:
    """Bibliography headings of each document: their number, the last one before the title, the last one from it on.

    ``paragraphs``: key, no, text, title. Positions are null where there is none.
    """
    title_at = F.min(F.when((F.length("title") > 0) & F.contains(F.lower("text"), F.lower("title")), F.col("no"))).over(W.partitionBy(key))
    rows = paragraphs.withColumn("t", title_at).withColumn("h", F.col("text").rlike(heading))
    return rows.groupBy(key).agg(
        F.sum(F.col("h").cast("long")).alias("n_headings"), F.max(F.when(F.col("h") & (F.col("no") < F.col("t")), F.col("no"))).alias("last_before"), F.max(F.when(F.col("h") & (F.col("t").isNull() | (F.col("no") >= F.col("t"))), F.col("no"))).alias("last_after")
    )


def trim_email_lines(text: str | None) -> str | None:
    """Zone trimming of the e-mail lines of one text until none is left, in one pass over its lines.

    First the last line cuts the tail, as long as it is in the tail zone and no @ comes after it; then each
    line from the first on is cut with the head, with the tail, or alone. Zones are those of what is left.
    """
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(EMAIL_LINE, text)]
    while spans and (len(text) - spans[-1][0]) / len(text) <= 0.2 and "@" not in text[spans[-1][1] :]:
        text = text[: spans.pop()[0]]
    kept, at, before = [], 0, 0  # what is left of the text, up to ``at``, has ``before`` characters
    for start, end in spans:
        before += start - at
        left = before + len(text) - start
        if (before + end - start) / left <= 0.1:
            kept, before = [], 0
        elif (left - before) / left <= 0.2:
            return "".join(kept) + text[at:start]
        else:
            kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:]


def trim_emails(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Zone trimming of e-mail lines until none is left; each text is one step of a per-text kernel."""
    trimmed = F.pandas_udf(lambda texts: texts.map(trim_email_lines, na_action="ignore"), "string")
    return docs.select(key, trimmed("text").alias("text"))


# Headings of a list of references and of keywords.
BIBLIOGRAPHY = r"(?ium)^[^\S\n]*(список литературы|литература|библиографический список|библиография|список\s{0,5}использованных\s{0,5}источников|список\s{0,5}использованной\s{0,5}литературы|references|bibliography).{0,5}$"
KEYWORDS = r"(?ium)^\s*(Ключевые слова|Список ключевых слов|Keywords)\s*[-.:]?\s*(.+)\n"


def cut_bibliography(text: Column, title: Column | None = None, last: bool = False) -> Column:
    """The text before the line of the first bibliography heading, or of the last one; with a title that the text holds, headings after it count.

    What is cut is where the line was found: the same words may be part of an earlier line, and blank lines before it stay.
    """
    if title is not None:
        at = F.call_function("instr", F.lower(text), F.lower(title))
        head = F.when((F.length(title) > 0) & (at > 0), at + F.length(title) - 1).otherwise(0)
        return F.concat(F.substring(text, F.lit(1), head), cut_bibliography(F.substring(text, head + 1, F.length(text)), last=last))
    if not last:
        return F.split(text, BIBLIOGRAPHY, 2)[0]
    found = F.regexp_extract_all(text, F.lit(BIBLIOGRAPHY), F.lit(0))
    end = F.length(F.element_at(F.split(text, BIBLIOGRAPHY, -1), -1)) + F.length(F.element_at(found, -1))
    return F.when(F.size(found) == 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) - end))


def inline_keywords(text: Column) -> Column:
    found = F.regexp_extract(text, KEYWORDS, 2)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(found, ","), lambda k: F.trim(k)))


def drop_upper_bibliography(paragraphs: Column, heading_at: Column) -> Column:
    """Paragraphs without the heading at ``heading_at`` (0-based, null: none) and the numbered ones right after it."""
    numbered = r"^(\s*\d+\.\s+)+"
    flagged = F.aggregate(
        F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside")),
        lambda s, x: F.when(x["i"] == heading_at, F.struct(s["out"].alias("out"), F.lit(True).alias("inside")))
        .when(s["inside"] & x["p"].rlike(numbered), F.struct(s["out"].alias("out"), F.lit(True).alias("inside")))
        .otherwise(F.struct(F.concat(s["out"], F.array(x["p"])).alias("out"), F.lit(False).alias("inside"))),
    )
    return F.when(heading_at.isNull(), paragraphs).otherwise(flagged["out"])


def complete_abstract(abstract: Column, text: Column) -> Column:
    """A shortened abstract (ending in ...) completed from its line in the text; a missing one from its heading."""
    stem = F.regexp_replace(abstract, r"\.\.\.$", "")
    at = F.call_function("instr", text, stem)
    line = F.split(F.substring(text, at, F.length(text)), "\n")[0]
    heading = F.regexp_extract(text, r"\n\s*Аннотация\.?\s*(.+)\n", 1)
    return (
        F.when((F.length(abstract) > 3) & abstract.endswith("...") & (at > 0), line).when(F.coalesce(F.length(abstract), F.lit(0)) == 0, heading).otherwise(abstract)
    )


def group_sizes(rows: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Groups with at least ``least`` members, and the size of each."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """Distinct cleaned tags of an array column over all rows."""
    return rows.select(F.explode(filter_tags(F.col(column))).alias("tag")).distinct()
