"""Pages to records. Real pages are no well-formed XML, so a tolerant parser runs over Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import preview_meta

SKIPPED = {"script", "style", "nav", "noscript", "head"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "wbr"}


#: Elements that begin and end a stretch of text.
BLOCKS = {"p", "div", "h1", "h2", "h3", "li", "article", "body", "ul", "ol"}


class _Page(HTMLParser):
    """Title, headings, paragraphs, and (class, text, href) of marked elements, without skipped parts and advertisements.

    A marked block gives each of its stretches of text, a marked element inside a line its own text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.headings, self.marked, self.links = "", [], [], [], []
        self.stack: list[list] = []  # tag, class, and for an element inside a line where its text begins in the buffer
        self.buffer: list[str] = []
        self.open_title = False

    def text_from(self, start: int) -> str:
        return " ".join("".join(self.buffer[start:]).split())

    def flush(self) -> None:
        text = self.text_from(0)
        if text:
            tag = next((t for t, *_ in reversed(self.stack) if t in ("h1", "h2", "h3", "p", "li", "article", "div", "body")), "p")
            (self.headings if tag in ("h1", "h2", "h3") else self.paragraphs).append(text)
            for entry in self.stack:
                if entry[1] and entry[2] is None:
                    self.marked.append((entry[1], text))
        for entry in self.stack:
            if entry[2] is not None:
                self.mark(entry)
                entry[2] = 0
        self.buffer = []

    def mark(self, entry: list) -> None:
        if entry[1] and entry[2] is not None and (text := self.text_from(entry[2])):
            self.marked.append((entry[1], text))

    def close_last(self) -> str:
        entry = self.stack.pop()
        self.mark(entry)
        return entry[0]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in BLOCKS or tag == "br":
            self.flush()
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.close_last()
        if tag == "li":  # an item that was left open ends where the next one of its list begins
            inner = [t for t, *_ in self.stack]
            if "li" in inner and not any(t in ("ul", "ol") for t in inner[len(inner) - inner[::-1].index("li") :]):
                while self.close_last() != "li":
                    pass
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        self.open_title |= tag == "title"
        if tag not in VOID:
            self.stack.append([tag, a.get("class") or "", None if tag in BLOCKS else len(self.buffer)])

    def handle_endtag(self, tag):
        if tag == "title":
            self.open_title = False
        if tag in BLOCKS:
            self.flush()
        if any(t == tag for t, *_ in self.stack):
            while self.stack and self.close_last() != tag:
                pass

    def handle_data(self, data):
        if self.open_title:
            self.title += data
        elif not any(t in SKIPPED or "ad" in c.split() for t, c, _ in self.stack):
            self.buffer.append(data)


def parse(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, headings, paragraphs, links, and marked (class and text) of each page."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf[key], pdf["html"]):
                p = _Page()
                p.feed(html or "")
                p.close()
                p.flush()
                rows.append((page_id, p.title.strip(), p.headings, p.paragraphs, p.links, [{"name": n, "text": t} for n, t in p.marked]))
            yield pd.DataFrame(rows, columns=[key, "title", "headings", "paragraphs", "links", "marked"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, title string, headings array<string>, paragraphs array<string>, links array<string>, marked array<struct<name: string, text: string>>")


def _first(name: str):
    return F.get(F.filter("marked", lambda m: F.array_contains(F.split(m["name"], " "), name)), F.lit(0))["text"]


def _all(name: str):
    return F.transform(F.filter("marked", lambda m: F.array_contains(F.split(m["name"], " "), name)), lambda m: m["text"])


def library_article(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Article records of a library page: valid only with its heading; similar links point to articles."""
    heading = F.get(F.filter("headings", lambda h: h.contains("Текст научной работы")), F.lit(0))
    return parsed.select(
        key, F.when(heading.isNotNull(), "ok").otherwise("title_not_found").alias("status"), F.regexp_extract(heading, "«(.*)»", 1).alias("title"), _first("infoblock-topic").alias("topic"),
        _first("year").alias("year"), F.transform(_all("author"), lambda a: F.trim(a)).alias("authors"), _all("keyword").alias("keywords"), _first("abstract").alias("abstract"), "paragraphs",
        F.filter("links", lambda x: x.startswith("/article/n/")).alias("similar"),
    )


class _Listing(HTMLParser):
    """Topic and article entries of a category page: what stands in ``div.main`` in its ``h1`` and its ``ul.list``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = []
        self.valid, self.topic, self.mark = False, "", ""
        self.items: list[dict] = []

    def within(self, tag: str, name: str = "") -> bool:
        return any(t == tag and (not name or name in c.split()) for t, c in self.path)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        if tag == "li":
            while self.within("li"):
                self.path.pop()
        self.path.append((tag, a.get("class") or ""))
        self.valid |= self.within("div", "main")
        if self.within("div", "main") and self.within("ul", "list"):
            if tag == "li":
                self.items.append({"url": None, "title": "", "abstract": "", "meta": ""})
            elif tag == "a" and self.items and self.items[-1]["url"] is None:
                self.items[-1]["url"] = a.get("href") or ""

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.within("div", "main"):
            return
        if self.within("h1"):
            if self.within("span"):
                self.mark += data
            elif not self.mark:
                self.topic += data
        elif self.within("ul", "list") and self.within("a") and self.items:
            part = "title" if self.within("div", "title") else "abstract" if self.within("p") else "meta" if self.within("span") else None
            if part:
                self.items[-1][part] += data


# Fixed value: what marks the heading of a category page.
LISTING = "список научных статей"


def category_previews(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Article previews of category pages: key, no (from 1), topic, url, title, abstract, year and authors.

    The topic is empty if the heading does not carry its mark; a page without its main part gives no rows.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf[key], pdf["html"]):
                p = _Listing()
                p.feed(html or "")
                p.close()
                topic = p.topic.strip() if p.mark.strip().lower() == LISTING else ""
                rows += [(page_id, i, topic, x["url"], x["title"], x["abstract"], x["meta"]) for i, x in enumerate(p.items, 1)]
            yield pd.DataFrame(rows, columns=[key, "no", "topic", "url", "title", "abstract", "meta"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, "html").mapInPandas(run, f"{key} {kind}, no long, topic string, url string, title string, abstract string, meta string")
    year, authors = preview_meta(F.col("meta"))
    return found.select(key, "no", "topic", "url", "title", "abstract", year.alias("year"), F.when(year.isNotNull(), authors).alias("authors"))


def blog_post(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Post records of a blog page: ok if it has a post title; the type is 'Unspecified' without one."""
    title = _first("post__title-text")
    return parsed.select(
        key, F.when(title.isNotNull(), "ok").otherwise("not_found").alias("status"), title.alias("title"), _first("post__time").alias("time"), F.coalesce(_first("post__type-label"), F.lit("Unspecified")).alias("type"),
        _all("hub-link").alias("hubs"), _all("post__tag").alias("tags"), F.array_join(_all("post__text"), "\n").alias("text"),
    )
