"""Publication search: optional predicates, any-of matches, paging."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.session import stage


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """First day of a yyyy-MM month and of the next; an impossible month raises ValueError."""
    first = dt.date.fromisoformat(month + "-01")
    return first, (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def in_month(d: Column, month: str) -> Column:
    """Half-open range, so that it can be pushed to the scan."""
    a, b = month_bounds(month)
    return (d >= F.lit(a)) & (d < F.lit(b))


def publications(papers: DataFrame, articles: DataFrame, admin_id: int | None = None, month: str | None = None, q: str | None = None, status: str | None = "ACTIVE") -> DataFrame:
    """Papers of a status (active ones, unless another or None is given), of an admin, of a month, matching ``q``: in the title, in yyyy-MM of the date, or in
    the title of one of its active articles; each argument only if it is given. % and _ in ``q``
    keep their meaning. One row per paper id; ties between repeated rows are broken arbitrarily.
    The match on articles is a semi join decided per paper (existence), never a row blow-up."""
    if status is not None:
        papers = papers.filter(F.col("status") == status)
    if admin_id is not None:
        papers = papers.filter(F.col("admin_id") == admin_id)
    if month:
        papers = papers.filter(in_month(F.col("published_date"), month))
    q = (q or "").strip()
    if not q:
        return papers.dropDuplicates(["id"])
    like = f"%{q.lower()}%"
    hits = articles.filter((F.col("status") == "ACTIVE") & F.lower("title").like(like)).select(F.col("paper_id").alias("__paper")).dropna().distinct()
    any_of = [F.date_format("published_date", "yyyy-MM").like(f"%{q}%"), F.lower("title").like(like), F.col("__paper").isNotNull()]
    if re.fullmatch(r"\d{4}-\d{2}", q):
        any_of.append(in_month(F.col("published_date"), q))
    matched = papers.join(hits, papers["id"] == F.col("__paper"), "left").filter(reduce(or_, [F.coalesce(c, F.lit(False)) for c in any_of]))
    return matched.drop("__paper").dropDuplicates(["id"])


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) in this order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def newest_first(date: str = "published_date", key: str = "id") -> list[Column]:
    """Date descending with nulls first, then the key."""
    return [F.col(date).desc_nulls_first(), F.col(key).asc()]


def summaries(papers: DataFrame, admins: DataFrame) -> DataFrame:
    """id, published_date, title, preview, admin_name; a paper without admin stays."""
    a = admins.select(F.col("id").alias("admin_id"), "press_company", "login_id")
    return papers.join(a, "admin_id", "left").select("id", "published_date", "title", text.preview(F.col("content")).alias("preview"), text.display_name(F.col("press_company"), F.col("login_id")).alias("admin_name"))


def publication_list(papers: DataFrame, articles: DataFrame, admins: DataFrame, admin_id: int, month: str | None = None, q: str | None = None, number: int = 1, size: int = 10) -> DataFrame:
    """A page of an admin's active papers, newest first (ties by id), as summaries with the ``total``
    of all pages. The matches are found once and staged; only the page is joined to its admin."""
    hits = stage(publications(papers, articles, admin_id, month, q).select("id", "published_date", "title", "content", "admin_id"), "publications")
    shown = page(hits, newest_first(), number, size)
    return summaries(shown, admins).withColumn("total", F.lit(hits.count()).cast("bigint"))


def reports(df: DataFrame, status: str | None = None) -> DataFrame:
    """Reports of a status (all if none has text)."""
    return df.filter(F.col("status") == status) if status and status.strip() else df
