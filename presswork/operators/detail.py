"""Article and issue detail: joins and list assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators.emotions import emotion_stats, own_emotion


def article_base(articles: DataFrame, papers: DataFrame, admins: DataFrame) -> DataFrame:
    """Articles that have a paper and an admin, with both."""
    p = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), "published_date")
    a = admins.select(F.col("id").alias("admin_id"), F.col("press_company"))
    return articles.select("id", "title", "summary", "reporter", "image_path", "paper_id", "admin_id").join(p, "paper_id").join(a, "admin_id")


def unlinked(articles: DataFrame, papers: DataFrame, admins: DataFrame) -> DataFrame:
    """Articles that ``article_base`` leaves out."""
    return articles.select("id", "title").join(article_base(articles, papers, admins).select("id"), "id", "left_anti")


def keyword_lists(article_keywords: DataFrame, keywords: DataFrame, sep: str = "|") -> DataFrame:
    """article_id, keywords, n_keywords: distinct names sorted; links without a keyword don't count.

    Names are made distinct before the lists, so a repeated delivery can't grow a list."""
    names = keywords.select(F.col("id").alias("keyword_id"), "name").filter("name is not null")
    pairs = article_keywords.join(names, "keyword_id").select("article_id", "name").distinct()
    got = pairs.groupBy("article_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return got.select("article_id", F.array_join("names", sep).alias("keywords"), F.size("names").cast("bigint").alias("n_keywords"))


def publication_articles(papers: DataFrame, articles: DataFrame, article_keywords: DataFrame, keywords: DataFrame) -> DataFrame:
    """paper_id, article_id, title, summary, image_path, keywords ('' where none) of every paper's
    active articles."""
    lists = keyword_lists(article_keywords, keywords)
    a = articles.filter(F.col("status") == "ACTIVE").select(F.col("id").alias("article_id"), "paper_id", "title", "summary", "image_path").join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return a.join(lists, "article_id", "left").select("paper_id", "article_id", "title", "summary", "image_path", F.coalesce("keywords", F.lit("")).alias("keywords"))


def issue_articles(papers: DataFrame, articles: DataFrame) -> DataFrame:
    """paper_id, published_date, article_count, titles (in id order) of every paper."""
    per = articles.filter("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "title"))).alias("list"))
    joined = papers.select(F.col("id").alias("paper_id"), "published_date").join(per, "paper_id", "left")
    titles = F.array_join(F.transform("list", lambda x: F.coalesce(x["title"], F.lit(""))), "|")
    return joined.select("paper_id", "published_date", F.coalesce("n", F.lit(0)).cast("bigint").alias("article_count"), F.coalesce(titles, F.lit("")).alias("titles"))


def related_preview(related: DataFrame, articles: DataFrame) -> DataFrame:
    """article_id, related_id, title, excerpt, score; rows whose article is missing drop out."""
    a = articles.select(F.col("id").alias("related_id"), "title", text.excerpt(F.col("content")).alias("excerpt"))
    return related.join(a, "related_id").select("article_id", "related_id", "title", "excerpt", "score")


def related_list(related: DataFrame, name: str) -> DataFrame:
    """article_id, ``name``: related ids, best score first (ties by id); at most k of each article."""
    got = related.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("related_id").alias("id")))).alias("list"))
    return got.select("article_id", F.array_join(F.transform("list", lambda x: x["id"].cast("string")), "|").alias(name))


def article_detail(articles: DataFrame, papers: DataFrame, admins: DataFrame, states: DataFrame, article_keywords: DataFrame, keywords: DataFrame, related: DataFrame, policies: DataFrame, user: int | None = None) -> DataFrame:
    """The base row with standing reactions, the user's own one (null if none), keywords, related
    articles and policies ('' where none): children are aggregated before they are joined."""
    stats = emotion_stats(articles.select("id"), states)
    lists = keyword_lists(article_keywords, keywords)
    base = article_base(articles, papers, admins)
    own = own_emotion(states, user).select(F.col("article_id").alias("id"), F.col("emotion_type").alias("my_emotion"))
    for d in (related_list(related, "related"), related_list(policies, "policies")):
        name = d.columns[1]
        base = base.join(d.withColumnRenamed("article_id", "id"), "id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    base = base.join(own, "id", "left")
    return base.join(stats.withColumnRenamed("article_id", "id"), "id", "left").join(lists.withColumnRenamed("article_id", "id"), "id", "left").withColumn("keywords", F.coalesce("keywords", F.lit(""))).withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0)).cast("bigint"))
