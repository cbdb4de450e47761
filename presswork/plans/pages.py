"""Crawl and page-layout queries.

There is no page geometry among the tables: line items stand in for lines on a page (an order is a
document, its line number the page), crawled articles for pages and list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.operators import html as hp
from presswork.operators import layout as lo
from presswork.operators import publish as pb
from presswork.plans.base import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql



def _pages(t: Tables) -> DataFrame:
    return t.articles.select(F.col("id").alias("page_id"), hp.article_page(F.col("title"), F.col("content")).alias("html"), "title", "content")


@R.add("select id page_id, substring(coalesce(title, ''), 1, 255) title from articles")
def q_page_titles(t: Tables) -> DataFrame:
    return _pages(t).select("page_id", hp.page_title(F.col("html")).alias("title"))


@R.add(r"select id page_id, trim(regexp_replace(coalesce(content, ''), '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{0085}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g')) body_text from articles")
def q_page_body_text(t: Tables) -> DataFrame:
    return hp.with_body_text(_pages(t))


def _list_pages(t: Tables) -> DataFrame:
    """One list page per host: links in id order."""
    host = F.regexp_extract("link", "//([^/]+)", 1)
    d = t.articles.filter("link like '%articleView.html?idxno=%'").select(host.alias("page_id"), "id", F.concat(F.lit('<li><a href="'), "link", F.lit('">x</a></li>')).alias("li"))
    return lo.joined_text(d, ["page_id"], "id", "li", "").withColumnRenamed("text", "html")


@R.add("""select regexp_extract(link, '//([^/]+)', 1) page_id, row_number() over (partition by regexp_extract(link, '//([^/]+)', 1) order by id) pos, link href from articles where link like '%articleView.html?idxno=%'""")
def q_page_links(t: Tables) -> DataFrame:
    return hp.page_links(_list_pages(t))


@R.add("""with h as (select id, case id % 3 when 0 then '/news/' || id when 1 then 'http://h/' || id else 'articleView.html?idxno=' || id end href from articles)
select id, case when href like '/%' then 'https://base' || href when href like 'http%' then href else 'https://base/news/' || href end link from h""")
def q_link_resolution(t: Tables) -> DataFrame:
    n = F.col("id").cast("string")
    href = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/news/"), n)).when(F.col("id") % 3 == 1, F.concat(F.lit("http://h/"), n)).otherwise(F.concat(F.lit("articleView.html?idxno="), n))
    return t.articles.select("id", tx.absolute_url(href, "https://base").alias("link"))


@R.add("""with c as (select regexp_extract(link, '//([^/]+)', 1) site, link, status, row_number() over (partition by regexp_extract(link, '//([^/]+)', 1) order by id desc) - 1 rn from articles where link like 'http%'),
k as (select distinct link from c where lower(trim(status)) = 'expired'),
s as (select site, rn // 20 + 1 page, rn % 20 + 1 pos, link, case when link in (select link from k) or row_number() over (partition by site, link order by rn) > 1 then 1 else 0 end stop from c where rn // 20 + 1 <= 100)
select site, cast(page as bigint) page, cast(pos as bigint) pos, link from (select *, max(stop) over (partition by site order by page, pos rows unbounded preceding) m from s) where m = 0""")
def q_crawl_cutoff(t: Tables) -> DataFrame:
    d = t.articles.filter("link like 'http%'").withColumn("site", F.regexp_extract("link", "//([^/]+)", 1))
    d = lo.numbered(d, ["site"], [F.col("id").desc()])
    d = d.select("site", (F.floor((F.col("n") - 1) / 20) + 1).alias("page"), ((F.col("n") - 1) % 20 + 1).alias("pos"), "link", "status")
    return hp.crawl_cutoff(d.drop("status"), d.filter("lower(trim(status)) = 'expired'"))


def _lines(t: Tables) -> DataFrame:
    """Line items as boxes on pages of 1000 x 1000."""
    li = t.lineitem
    x, y = F.col("l_partkey") % 900, F.col("l_suppkey") * 7 % 950
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_extendedprice").alias("line_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.lit("기사"), "l_linenumber", F.lit("면 이어짐")).alias("text"),
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        (x + 80).cast("double").alias("x1"),
        (y + 12).cast("double").alias("y1"),
        F.col("l_quantity").alias("max_size"),
    )


LINES = """lines as (select l_orderkey doc_id, l_linenumber page, l_partkey || '-' || l_suppkey || '-' || l_extendedprice line_id,
cast(l_partkey % 900 as double) x0, cast(l_suppkey * 7 % 950 as double) y0, cast(l_partkey % 900 + 80 as double) x1, cast(l_suppkey * 7 % 950 + 12 as double) y1, l_quantity max_size, l_partkey, l_suppkey, l_extendedprice, l_returnflag || ' ' || l_linestatus || ' 기사 ' || l_linenumber || ' 면 이어짐' "text" from lineitem)"""


@R.add("""with r as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity) rn, count(*) over (partition by l_suppkey) n from lineitem)
select l_suppkey, l_quantity median from r where rn = n // 2 + 1""")
def q_font_upper_median(t: Tables) -> DataFrame:
    return lo.upper_median(t.lineitem, ["l_suppkey"], "l_quantity")


@R.add(f"""with {LINES}, g as (select doc_id, x0, x1 - x0 w, row_number() over (partition by doc_id order by x0, page, line_id) seq, y1, max_size from lines),
m as (select *, greatest(2 * coalesce(avg(case when w > 0 then w end) over (partition by doc_id), 5.0), 20.0) lim, x0 - lag(x0 + w) over (partition by doc_id order by x0, seq) gap from g),
p as (select *, sum(case when gap > lim then 1 else 0 end) over (partition by doc_id order by x0, seq) part from m)
select doc_id, cast(part as bigint) part, min(x0) x0, max(x0 + w) x1, min(y1 - 12) y0, max(y1) y1, max(max_size) max_size, cast(count(*) as bigint) n from p group by 1, 2""")
def q_glyph_line_split(t: Tables) -> DataFrame:
    d = lo.numbered(_lines(t).drop("text"), ["doc_id"], ["x0", "page", "line_id"])
    glyphs = d.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.col("n").alias("seq"), F.lit("x").alias("ch"), F.col("x0").alias("x"), F.col("y1").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), F.lit(12.0).alias("h"), F.col("max_size").alias("font_size"))
    pages = glyphs.select("doc_id", "page").distinct().withColumn("width", F.lit(1000.0))
    got = lo.split_lines(glyphs, pages)
    return got.select("doc_id", "part", "x0", "x1", "y0", "y1", "max_size", F.length("text").cast("bigint").alias("n"))


@R.add(f"""with {LINES}, g as (select doc_id, x0, lead(x0) over (partition by doc_id order by x0) - x0 gap, row_number() over (partition by doc_id order by x0) pos from lines),
r as (select *, row_number() over (partition by doc_id order by gap desc, pos) rank from g where gap is not null)
select doc_id, gap, x0 "at", rank from r where rank <= 6""")
def q_gap_candidates(t: Tables) -> DataFrame:
    return lo.gap_candidates(_lines(t).select("doc_id", "x0"), ["doc_id"], "x0")


@R.add()
def q_column_splits(t: Tables) -> DataFrame:
    """Lines in reading order per document, with their column."""
    return lo.in_reading_order(_lines(t), "doc_id", 1000.0)


BAD = " or ".join(f"contains(t, '{w}')" for w in tx.TITLE_BAD_WORDS)


@R.add(rf"""with d as (select id, title t, 10.0 + id % 12 size, 10.0 + id % 2 median from articles)
select id, coalesce(length(t) between 3 and 80 and size >= greatest(median * 1.38, 12.5) and not (length(t) < 20 and ({BAD}))
and length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) / greatest(length(t), 1) <= 0.35 and not regexp_full_match(t, '\d+\s+\S{{1,3}}|\S{{1,3}}\s+\d+') and not regexp_matches(t, '^[▶▷]'), false) title from d""")
def q_title_candidates(t: Tables) -> DataFrame:
    size, med = (F.col("id") % 12 + 10).cast("double"), (F.col("id") % 2 + 10).cast("double")
    return t.articles.select("id", F.coalesce(tx.is_probable_title(F.col("title"), size, med), F.lit(False)).alias("title"))


@R.add(f"""with {LINES}, b as (select distinct o.o_orderkey doc_id, l.page, b.i box_id, b.i * 250.0 x0, 0.0 y0, b.i * 250.0 + 300.0 x1, 500.0 y1 from (select distinct doc_id, page from lines) l join orders o on o.o_orderkey = l.doc_id, (values (0), (1), (2)) b(i))
select l.doc_id, l.page, b.box_id, l.line_id, l.text from lines l join b on l.doc_id = b.doc_id and l.page = b.page and (l.x0 + l.x1) / 2 between b.x0 and b.x1 and (l.y0 + l.y1) / 2 between b.y0 and b.y1""")
def q_body_lines(t: Tables) -> DataFrame:
    pages = _lines(t).select("doc_id", "page").distinct().join(t.orders.select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    box = F.explode(F.array(*(F.struct(F.lit(i).alias("box_id"), F.lit(i * 250.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(i * 250.0 + 300).alias("x1"), F.lit(500.0).alias("y1")) for i in range(3))))
    return lo.body_lines(_lines(t), pages.select("doc_id", "page", box.alias("b")).select("doc_id", "page", "b.*"))


@R.add(f"""with {LINES}, t as (select doc_id, line_id, x0, x1, y0 from lines),
n as (select a.doc_id, a.line_id title_id, min(b.y0) y from t a left join t b on a.doc_id = b.doc_id and (b.y0 > a.y0 or (b.y0 = a.y0 and b.line_id > a.line_id)) and abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= 220 group by 1, 2)
select doc_id, title_id, coalesce(y - 2, 1000.0) body_bottom from n""")
def q_next_title(t: Tables) -> DataFrame:
    d = _lines(t).select("doc_id", F.lit(1).alias("page"), F.col("line_id").alias("title_id"), "x0", "x1", "y0", F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return lo.next_title(d)


@R.add(f"""with {LINES} select doc_id, page, line_id, 'p' || lpad(cast(page as varchar), 2, '0') || '_a' || lpad(cast(row_number() over (partition by doc_id, page order by y0, x0, line_id) as varchar), 3, '0') article_id from lines""")
def q_article_numbering(t: Tables) -> DataFrame:
    return pb.article_ids(_lines(t)).select("doc_id", "page", "line_id", "article_id")


@R.add(f"""with {LINES} select doc_id, string_agg(line_id, '|' order by y0, x0, page, line_id) ids from lines group by 1""")
def q_page_concatenation(t: Tables) -> DataFrame:
    d = _lines(t).withColumn("o", F.struct("y0", "x0", "page", "line_id"))
    return lo.joined_text(d, ["doc_id"], "o", "line_id", "|").withColumnRenamed("text", "ids")


@R.add(f"""with {LINES} select doc_id, line_id image_id, x0, 1000.0 - y0 - (y1 - y0) y0, x1, 1000.0 - y0 y1 from lines""")
def q_image_bbox(t: Tables) -> DataFrame:
    d = _lines(t).select("doc_id", "page", F.col("line_id").alias("image_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    pages = d.select("doc_id", "page").distinct().withColumn("height", F.lit(1000.0))
    return lo.image_boxes(d, pages).select("doc_id", "image_id", "x0", "y0", "x1", "y1")


@R.add()
def q_page_articles(t: Tables) -> DataFrame:
    """Whole layout analysis: titles, columns, bodies of every document."""
    d = _lines(t).withColumns({"page": F.lit(1), "text": F.concat(F.lit("줄 하나가 서른 자를 넘도록 길게 쓴 본문 글줄 "), "line_id")})
    sizes = d.select("doc_id", "page", F.lit(10.0).alias("font_size"))
    pages = d.select("doc_id", "page").distinct().withColumns({"width": F.lit(1000.0), "height": F.lit(1000.0)})
    return lo.articles(d, sizes, pages)
