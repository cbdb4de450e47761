"""Crawled pages: titles, links, text, and where a crawl stops."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = r"""href=["']([^"']*articleView\.html\?idxno=[^"']*)["']"""


_PART = r"""(?:[^>"']+|"[^"]*"|'[^']*')"""
OG_TITLE = rf"""(?is)(<meta\b(?=[^>]*?\bproperty\s*=\s*["']?og:title["'\s/>]){_PART}*+>)"""


def page_title(html: Column) -> Column:
    """og:title if the tag is there, even empty and whatever the order of its attributes, else
    <title> with its white space squeezed; entities decoded; at most 255 characters."""
    tag = F.regexp_extract(html, OG_TITLE, 1)
    content = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, content, i) for i in (1, 2, 3)))
    plain = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.substring(unescape(F.when(tag != "", value).otherwise(plain)), 1, 255)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of article links in the order they stand."""
    got = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    return pages.select("page_id", F.posexplode(got).alias("pos", "href")).select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "href")


class _Texts(HTMLParser):
    """Visible text, and apart from it the text of the body container and of article paragraphs."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.body, self.main, self.paras = [], [], []
        self.saw_main = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            for out in (self.body, self.main, self.paras):
                out.append(" ")
            return
        a = dict(attrs)
        cls = a.get("class") or ""
        up = self.stack[-1] if self.stack else ("", False, False, False)
        main = up[1] or a.get("id") == "article-view-content-div"
        self.saw_main |= main
        article = up[2] or (tag == "div" and "article" in cls)
        para = up[3] or (tag == "p" and (up[2] or "content" in cls.split()))
        self.stack.append((tag, main, article, para))

    def handle_endtag(self, tag: str) -> None:
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                del self.stack[n:]
                break
        for out in (self.body, self.main, self.paras):
            out.append(" ")

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ("", False, False, False)
        if any(s[0] in ("script", "style", "head", "title") for s in self.stack):
            return
        self.body.append(data)
        if top[1]:
            self.main.append(data)
        if top[3]:
            self.paras.append(data)


def text_of(html: str | None) -> str | None:
    """The article's text: its container, else paragraphs of article blocks, else all; white space
    squeezed. Null for null."""
    if html is None:
        return None
    p = _Texts()
    p.feed(html)
    p.close()
    squeeze = lambda parts: re.sub(r"\s+", " ", "".join(parts)).strip()
    return squeeze(p.main) if p.saw_main else squeeze(p.paras) or squeeze(p.body)


def _texts(col: pd.Series) -> pd.Series:
    return col.map(text_of)


def with_body_text(pages: DataFrame) -> DataFrame:
    """page_id, body_text of every page."""
    return pages.select("page_id", F.pandas_udf(_texts, "string")("html").alias("body_text"))


def article_page(title: Column, content: Column) -> Column:
    """A page as the crawler meets it: used to give the parsers whole tables as input."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    body = F.concat(F.lit('<div id="article-view-content-div"><p>'), esc(F.coalesce(content, F.lit(""))), F.lit("</p></div>"))
    return F.concat(F.lit('<html><head><meta property="og:title" content="'), esc(F.coalesce(title, F.lit(""))), F.lit('"><title>x</title></head><body>'), body, F.lit("<div>footer</div></body></html>"))


def _decoded(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Character references as characters; null for null. There is no built-in function for it."""
    return F.pandas_udf(_decoded, "string")(c)


def without_empty(rows: DataFrame) -> DataFrame:
    """Crawled rows (title, content) but for those with neither."""
    return rows.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("content", F.lit("")) != ""))


def crawl_cutoff(candidates: DataFrame, known: DataFrame, site: str = "site", strict: bool = True, pages: int = 100) -> DataFrame:
    """site, page, pos, link of what a crawl saves: all before the first link that is known, in
    (page, pos) order, on at most ``pages`` list pages. ``strict``: a link met twice is known, as
    its first copy was just saved; otherwise repeats are left out and the crawl goes on."""
    there = known.select("link").dropna().distinct().withColumn("known", F.lit(1))
    d = candidates.filter(F.col("page") <= pages).join(there, "link", "left")
    again = F.row_number().over(Window.partitionBy(site, "link").orderBy("page", "pos")) > 1
    d = d.withColumn("again", again)
    stop = F.when(F.col("known").isNotNull() | (F.col("again") & F.lit(strict)), 1).otherwise(0)
    w = Window.partitionBy(site).orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("stop", F.max(stop).over(w)).filter("stop = 0 and not again").select(site, "page", "pos", "link")
