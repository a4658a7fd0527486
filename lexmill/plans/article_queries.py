"""Tags, names, pages, cleaning, ranges, stored keys and similar articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import articles, html
from lexmill.sources import files
from lexmill.streaming import windows

from .base import documents, query, rounded, table

# Example tags, and a Cyrillic article.
TAGS = ["О!   Привет медвед", "database as код", "ООП", "Блог компании X", "a б", "Паттерны проектирования", ""]
ARTICLE = "Вестник\nО паттернах\nE-mail: a@b.ru\nАннотация. Кратко.\nКлючевые слова: паттерн, объект , класс\nТекст про пат-\nтерны.\nСписок литературы\n1. Книга"
TAG_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAGS))
CLEAN_TAG = "CASE WHEN contains(lower(tag), 'блог компании') THEN NULL WHEN len(array_to_string(regexp_extract_all(tag, '(?i)[а-яё]+'), ' ')) >= 3 THEN array_to_string(regexp_extract_all(tag, '(?i)[а-яё]+'), ' ') END"


@query(f"SELECT doc_id, {CLEAN_TAG} AS clean FROM (SELECT d.doc_id, d.lang || ' ' || x.tag || ' ' || d.source AS tag FROM documents d JOIN (VALUES {TAG_VALUES}) x(no, tag) ON x.no = d.doc_id % {len(TAGS)})")
def validate_tag(spark, d):
    """Tags around each document's language and source, of which the Cyrillic words are kept."""
    tag = F.concat_ws(" ", "lang", F.element_at(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % len(TAGS) + 1).cast("int")), "source")
    return documents(spark, d).select("doc_id", tx.validate_tag(tag).alias("clean"))


@query(f"SELECT d.doc_id, x.clean, x.no FROM documents d, (SELECT no, {CLEAN_TAG} AS clean FROM (VALUES {TAG_VALUES}) x(no, tag)) x WHERE clean IS NOT NULL AND no % 5 = d.doc_id % 5")
def filter_tags(spark, d):
    rows = documents(spark, d).select("doc_id", F.explode(F.filter(F.transform(F.array(*map(F.lit, TAGS)), lambda t, i: F.struct(i.alias("no"), t.alias("tag"))), lambda x: x["no"] % 5 == F.col("doc_id") % 5)).alias("x"))
    return rows.groupBy("doc_id", "x.no").agg(F.first("x.tag").alias("tag")).select("doc_id", "no", F.explode(tx.filter_tags(F.array("tag"))).alias("clean")).select("doc_id", "clean", "no")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'ok'])), ' ') AS keywords FROM documents WHERE len(list_distinct([lang, source, 'ok'])) >= 2")
def keyword_union(spark, d):
    """Keywords of a post: the union of two tag lists; posts need two or more."""
    both = F.array_union(F.array("lang", F.lit("ok")), F.array("source"))
    return documents(spark, d).select("doc_id", both.alias("k")).where(F.size("k") >= 2).select("doc_id", F.array_join(F.array_sort("k"), " ").alias("keywords"))


@query("SELECT page_id, substr(md5(url), 1, 8) AS id FROM pages")
def hex_id(spark, d):
    return table(spark, d, "pages").select("page_id", tx.hex_id(F.col("url")).alias("id"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS last FROM pages")
def last_path_part(spark, d):
    return table(spark, d, "pages").select("page_id", tx.last_path_part(F.col("url")).alias("last"))


HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(f"SELECT page_id, CASE WHEN lower({HOST}) = (SELECT min({HOST}) FROM pages) THEN url ELSE '' END AS url FROM pages")
def url_host_check(spark, d):
    pages = table(spark, d, "pages")
    first = pages.agg(F.min(F.parse_url("url", F.lit("HOST"))).alias("host"))
    return pages.join(F.broadcast(first)).select("page_id", tx.on_host(F.col("url"), F.col("host")).alias("url"))


SAFE = "replace(regexp_replace(regexp_replace(url, '%[0-9A-Fa-f]{2}', '', 'g'), '[^0-9A-Za-zА-Яа-яЁё ._-]', '', 'g'), ' ', '_')"
END = f"regexp_extract({SAFE}, '(\\.[0-9A-Za-z]{{1,5}})$', 1)"


@query(f"SELECT page_id, substr(substr({SAFE}, 1, len({SAFE}) - len({END})), 1, 60 - len({END})) || {END} AS name FROM pages")
def fit_filename(spark, d):
    return table(spark, d, "pages").select("page_id", tx.fit_filename(F.col("url")).alias("name"))


def _decoded(x: str) -> str:
    """References of a title as HTML has them: these names also stand without their semicolon. ``&`` comes last, so that nothing is decoded twice."""
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("nbsp", 160), ("amp", 38)):
        x = f"regexp_replace({x}, '&{name};?', chr({code}), 'g')"
    return x


#: What Python takes for white space at the ends of a text.
SPACE = " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(f"SELECT page_id, trim({_decoded(TITLE)}, {SPACE}) AS title FROM pages")
def html_title(spark, d):
    return html.parse(table(spark, d, "pages")).select("page_id", F.trim("title").alias("title"))


@query()
def html_paragraphs(spark, d):
    return html.parse(table(spark, d, "pages")).select("page_id", F.posexplode("paragraphs").alias("no", "paragraph"))


@query()
def library_articles(spark, d):
    return html.library_article(html.parse(table(spark, d, "pages")))


@query()
def blog_posts(spark, d):
    return html.blog_post(html.parse(table(spark, d, "pages")))


PLAIN = "trim(regexp_replace(substr(text, 1, {n}), '[^A-Za-z]+', ' ', 'g'))"
RECORD = f"""SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN 'title_not_found' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 <> 0 THEN {PLAIN.format(n=40)} END AS title, lang AS topic,
      (2000 + doc_id % 20)::VARCHAR AS year, source || '|other' AS authors, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '|' || source END AS keywords, 'a' || {PLAIN.format(n=90)} AS abstract, '/article/n/' || source || '|/article/n/b' AS similar"""


def _plain(n):
    return F.trim(F.regexp_replace(F.substring("text", 1, n), "[^A-Za-z]+", " "))


def _library_pages(spark, d):
    """Pages of a library made of documents: heading, topic, year, authors, keywords, abstract, advertisement, links."""
    heading = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit('<h2 class="right-title">Текст научной работы на тему «'), _plain(40), F.lit("»</h2>"))).otherwise("<h2>x</h2>")
    keywords = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit('<ul><li class="keyword">'), "lang", F.lit('<li class="hot keyword">'), "source", F.lit("</ul>")))
    return documents(spark, d).select(
        F.col("doc_id").alias("page_id"),
        F.concat(
            F.lit('<html><head><title>t</title></head><body><nav class="year">1900</nav>'), heading, F.lit('<div class="infoblock-topic">'), "lang", F.lit('</div><div class="ad"><p class="abstract">buy</p></div><div class="year">'),
            (2000 + F.col("doc_id") % 20).cast("string"), F.lit('</div><ul><li class="author"> '), "source", F.lit(' </li><li class="author">other</ul>'), keywords, F.lit('<p class="abstract">a'), _plain(90), F.lit('<p>second<a href="/article/n/'), "source",
            F.lit('">s</a><a href="/else">e</a><a href="/article/n/b">b</a></body>'),
        ).alias("html"),
    )


@query(RECORD + " FROM documents")
def library_records(spark, d):
    """Article records read back from pages that hold the markup of a library."""
    found = html.library_article(html.parse(_library_pages(spark, d)))
    joined = [F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "similar")]
    return found.select("page_id", "status", "title", "topic", "year", joined[0], joined[1], "abstract", joined[2])


@query(
    f"""SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 0 THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN doc_id % 4 <> 0 THEN 't' || {PLAIN.format(n=30)} END AS title, '2024-01-' || (10 + doc_id % 20) AS time,
      CASE WHEN doc_id % 3 = 0 THEN 'Unspecified' ELSE lang END AS type, source || '|' || lang AS hubs, 'код' AS tags, 'x' || {PLAIN.format(n=120)} AS text FROM documents"""
)
def blog_records(spark, d):
    """Post records read back from pages that hold the markup of a blog."""
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit('<h1><span class="post__title-text">t'), _plain(30), F.lit("</span></h1>")))
    kind = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit('<div><span class="post__type-label">'), "lang", F.lit("</span></div>")))
    pages = documents(spark, d).select(
        F.col("doc_id").alias("page_id"),
        F.concat(
            F.lit("<html><body>"), title, F.lit('<div><span class="post__time">2024-01-'), (10 + F.col("doc_id") % 20).cast("string"), F.lit("</span></div>"), kind, F.lit('<ul><li><a class="inline-list__item-link hub-link">'), "source", F.lit('</a></li><li><a class="hub-link">'), "lang",
            F.lit('</a></li></ul><div class="post__text">x'), _plain(120), F.lit('</div><ul><li><a class="post__tag">код</a></ul></body></html>'),
        ).alias("html"),
    )
    found = html.blog_post(html.parse(pages))
    return found.select("page_id", "status", "title", "time", "type", F.array_join("hubs", "|").alias("hubs"), F.array_join("tags", "|").alias("tags"), "text")


@query("SELECT page_id, len(regexp_replace(html, '(?is)<div class=\"ad\">.*?</div>', '', 'g'))::BIGINT AS size FROM pages")
def drop_ads(spark, d):
    """Pages without their advertisement blocks (which hold no further blocks)."""
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", '(?is)<div class="ad">.*?</div>', "")).cast("long").alias("size"))


@query("SELECT doc_id, len(regexp_replace(replace(text, ' ', '-' || chr(10)), '(.)-\\n', '\\1', 'g'))::BIGINT AS size FROM documents")
def dehyphenate(spark, d):
    hyphenated = F.replace("text", F.lit(" "), F.lit("-\n"))
    return documents(spark, d).select("doc_id", F.length(tx.dehyphenate(hyphenated)).cast("long").alias("size"))


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'the ') > 0 THEN substr(text, strpos(lower(text), 'the ') + 4) ELSE text END AS rest FROM documents")
def cut_through_title(spark, d):
    return documents(spark, d).select("doc_id", tx.cut_through(F.col("text"), F.lit("the ")).alias("rest"))


MAIL = "[A-Za-z0-9.]+@[A-Za-z0-9.]+"


@query(
    f"""WITH hits AS (SELECT doc_id, text, regexp_extract(text, '{MAIL}', 0) AS hit FROM documents), at_ AS (SELECT *, strpos(text, hit) AS p, strpos(text, hit) + len(hit) - 1 AS e FROM hits)
    SELECT doc_id, CASE WHEN hit = '' THEN text WHEN e / len(text) <= 0.1 THEN substr(text, e + 1) WHEN (len(text) - (p - 1)) / len(text) <= 0.2 THEN substr(text, 1, p - 1)
      ELSE substr(text, 1, p - 1) || substr(text, e + 1) END AS text FROM at_"""
)
def email_zone_trim(spark, d):
    """One step of the zone rule on addresses."""
    return documents(spark, d).select("doc_id", tx.trim_once(F.col("text"), MAIL).alias("text"))


@query()
def email_trim_all(spark, d):
    texts = documents(spark, d).select("doc_id", F.concat(F.lit("E-mail: a@b.c\n"), F.col("text"), F.lit("\nE-mail: d@e.f\nend")).alias("text"))
    return articles.trim_emails(texts)


ARTICLE_SQL = "'" + ARTICLE.replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT doc_id, substr(a, 1, strpos(a, 'Список литературы') - 1) AS text FROM (SELECT doc_id, source || chr(10) || {ARTICLE_SQL} AS a FROM documents)")
def bibliography_cut(spark, d):
    text = F.concat("source", F.lit("\n" + ARTICLE))
    return documents(spark, d).select("doc_id", articles.cut_bibliography(text).alias("text"))


@query("SELECT doc_id, unnest(['паттерн', 'объект', 'класс', source]) AS keyword FROM documents")
def inline_keywords(spark, d):
    text = F.concat(F.lit("Начало\nКлючевые слова: паттерн, объект , класс, "), F.col("source"), F.lit("\nТекст"))
    return documents(spark, d).select("doc_id", F.explode(articles.inline_keywords(text)).alias("keyword"))


@query(
    """WITH p AS (SELECT doc_id, unnest(range(len(s))) AS no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    h AS (SELECT doc_id, no, regexp_matches(text, '^The') AS h, min(no) FILTER (contains(lower(text), 'thin')) OVER (PARTITION BY doc_id) AS t FROM p)
    SELECT doc_id, (count(*) FILTER (h))::BIGINT AS n_headings, (max(no) FILTER (h AND no < t))::BIGINT AS last_before, (max(no) FILTER (h AND (t IS NULL OR no >= t)))::BIGINT AS last_after FROM h GROUP BY doc_id"""
)
def literature_counts(spark, d):
    """Headings (lines that start with The) before and after the first line that holds a title."""
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "text")).withColumn("no", F.col("no").cast("long")).withColumn("title", F.lit("thin"))
    return articles.literature(rows, "^The")


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), (F.col("o_orderstatus") != "P").alias("saved"), "o_custkey", "o_orderpriority")


@query(
    """WITH n AS (SELECT o_orderkey AS number, lag(o_orderkey) OVER (ORDER BY o_orderkey) + 1 AS lo FROM orders WHERE o_orderkey % 7 <> 3)
    SELECT lo::BIGINT AS lo, (number - 1)::BIGINT AS hi FROM n WHERE lo < number UNION ALL SELECT max(number) + 1, NULL FROM n"""
)
def number_gaps(spark, d):
    return articles.number_gaps(_orders(spark, d).where("number % 7 <> 3"))


@query(
    """WITH n AS (SELECT o_orderkey AS number, o_orderstatus <> 'P' AS saved, o_orderpriority AS p FROM orders),
    s AS (SELECT *, CASE WHEN lag(number) OVER w = number - 1 AND NOT lag(saved) OVER w THEN 0 ELSE 1 END AS starts FROM n WINDOW w AS (PARTITION BY p ORDER BY number)),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY p ORDER BY number) AS run FROM s)
    SELECT p AS topic, min(number)::BIGINT AS lo, max(number)::BIGINT AS hi FROM r WHERE NOT saved GROUP BY p, run
    UNION ALL SELECT p, max(number) + 1, NULL FROM n GROUP BY p"""
)
def unsaved_islands(spark, d):
    return articles.unsaved_islands(_orders(spark, d).withColumnRenamed("o_orderpriority", "topic").select("topic", "number", "saved"), "topic")


RANGES = [(5, 20), (100, 130), (1000, None)]


def _ranges(spark):
    return spark.createDataFrame(RANGES, "lo long, hi long")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey BETWEEN 5 AND 20 OR o_orderkey BETWEEN 100 AND 130 OR o_orderkey >= 1000")
def range_member(spark, d):
    return articles.in_ranges(_orders(spark, d).select("number"), _ranges(spark))


@query("SELECT DISTINCT page_id AS page_no FROM pages, range(1, 21) t(i) WHERE page_id > 0 AND (page_id - 1) * 20 + i <= 2000 AND ((page_id - 1) * 20 + i BETWEEN 5 AND 20 OR (page_id - 1) * 20 + i BETWEEN 100 AND 130 OR (page_id - 1) * 20 + i >= 1000)")
def page_needs_load(spark, d):
    pages = table(spark, d, "pages").where("page_id > 0").select(F.col("page_id").alias("page_no"))
    return articles.pages_to_load(pages, _ranges(spark), 20, 2000)


@query(
    "SELECT d.doc_id AS number, coalesce(l.quality::VARCHAR, d.lang) AS topic, coalesce(nullif(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END, ''), l.toxic::VARCHAR) AS title FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def preview_backfill(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("number"), F.col("lang").alias("topic"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("title"))
    previews = table(spark, d, "labels").select(F.col("doc_id").alias("number"), F.col("quality").cast("string").alias("topic"), F.col("toxic").cast("string").alias("title"))
    return articles.back_fill(rows, previews, ["topic"], ["title"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_stored(spark, d):
    return articles.not_stored(documents(spark, d).select("doc_id", "lang"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def first_visits(spark, d):
    requests = table(spark, d, "labels").select("doc_id").unionAll(table(spark, d, "labels").select("doc_id"))
    return articles.first_visits(requests, documents(spark, d).select("doc_id", "lang"), "doc_id")


@query("SELECT o_orderkey AS number, o_custkey FROM orders WHERE o_orderkey >= 100 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 100) ORDER BY number LIMIT 500")
def offset_limit(spark, d):
    return articles.from_number(_orders(spark, d).select("number", "o_custkey"), 100, 500)


@query(
    """WITH RECURSIVE nodes AS (SELECT DISTINCT o_custkey AS node FROM orders),
    edges AS (SELECT a.o_custkey AS src, b.node AS dst FROM orders a JOIN nodes b ON b.node IN ((a.o_custkey * 7 + 1) % 1000, (a.o_custkey * 3 + 2) % 1000)),
    walk(node, round) AS (SELECT min(node), 0 FROM nodes UNION SELECT e.dst, w.round + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.round < 4 AND e.dst % 5 <> 0)
    SELECT node, min(round)::INTEGER AS round FROM walk GROUP BY node"""
)
def similar_expansion(spark, d):
    """Breadth-first expansion over customers; those divisible by 5 are not accepted."""
    nodes = _orders(spark, d).select(F.col("o_custkey").alias("node")).distinct()
    hops = nodes.select(F.col("node").alias("src"), F.explode(F.array((F.col("node") * 7 + 1) % 1000, (F.col("node") * 3 + 2) % 1000)).alias("dst"))
    return articles.similar(nodes, hops.distinct(), nodes.agg(F.min("node").alias("node")), F.col("node") % 5 != 0, 1_000_000, 4)


@query(
    """WITH RECURSIVE a AS (SELECT doc_id AS node, lang AS topic, unnest([source, 'a' || doc_id % 41]) AS author FROM documents),
    walk(node, round) AS (SELECT min(node), 0 FROM a UNION SELECT y.node, w.round + 1 FROM walk w JOIN a x ON x.node = w.node JOIN a y ON y.topic = x.topic AND y.author = x.author WHERE w.round < 4 AND y.node % 5 <> 0)
    SELECT node, min(round)::INTEGER AS round FROM walk GROUP BY node"""
)
def similar_by_authors(spark, d):
    """Documents reached through shared authors: a document's source and a part of its number stand for them."""
    rows = documents(spark, d).select(F.col("doc_id").alias("node"), F.col("lang").alias("topic"), F.array(F.concat(F.lit(" "), F.col("source")), F.concat(F.lit("a"), (F.col("doc_id") % 41).cast("string"))).alias("authors"))
    return articles.similar_by_authors(rows, rows.agg(F.min("node").alias("node")), F.col("node") % 5 != 0, 1_000_000, 4)


@query("SELECT DISTINCT o_orderkey AS number FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey BETWEEN l_partkey * 5 AND l_partkey * 5 + l_linenumber - 2)")
def in_many_ranges(spark, d):
    """Numbers in any of as many ranges as the items table has rows, overlapping and empty ones among them."""
    ranges = table(spark, d, "lineitem").select((F.col("l_partkey") * 5).alias("lo"), (F.col("l_partkey") * 5 + F.col("l_linenumber") - 2).alias("hi"))
    return articles.in_ranges(_orders(spark, d).select("number"), ranges)


@query(
    """WITH classes AS (SELECT lang, source, min(doc_id) AS class_id, count(DISTINCT doc_id) - 1 AS n_links FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source)
    SELECT DISTINCT d.doc_id AS node, d.lang AS topic, d.source AS author, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(c.n_links, 0)::BIGINT AS n_links
    FROM documents d LEFT JOIN classes c ON c.lang = d.lang AND c.source = d.source"""
)
def author_classes(spark, d):
    """Links of documents of one language and source: the class of each document, and how many others it is linked with."""
    return articles.author_edges(_authored(spark, d))


def _authored(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("node"), F.col("lang").alias("topic"), F.array(F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("authors"))


@query("SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id")
def author_edges(spark, d):
    """All pairs of documents of one language and source."""
    return articles.author_pairs(_authored(spark, d))


@query("SELECT page_id, url FROM pages UNION ALL SELECT page_id + 100000, url FROM pages")
def append_previews(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100_000))


@query("SELECT doc_id AS id, len(text)::BIGINT AS size FROM documents WHERE lang = 'en'")
def corpus_filter(spark, d):
    """Stored posts: marked and unusable ones are left out."""
    posts = documents(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "ok").otherwise("bad").alias("status"), F.lit("t").alias("title"), "text", F.array(F.lit("код")).alias("tags"), F.array(F.lit("ООП")).alias("hubs"))
    return files.blog_corpus(posts, 1).select("id", F.length("text").cast("long").alias("size"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def events_tumbling_stream(spark, d):
    """The batch twin of the streaming query: hourly counts by type."""
    return windows.tumbling_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))
