"""Keyword dictionary and mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.text import strip_control
from presswork.session import stage


def new_names(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """name: trimmed names with text that the dictionary lacks, once each."""
    trimmed = names.select(strip_control(F.col("name")).alias("name")).filter("name <> ''").distinct()
    return trimmed.join(keywords.select("name").filter("name is not null").distinct(), "name", "left_anti")


def upserted(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, name: the dictionary with new names appended. Ids continue the greatest one in name
    order within hash blocks; counts of the blocks, not the names, are brought together."""
    fresh = new_names(names, keywords).withColumn("block", F.pmod(F.xxhash64("name"), F.lit(1024)).cast("int"))
    size = fresh.groupBy("block").agg(F.count("*").alias("n"))
    base = size.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = keywords.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rn = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    numbered = fresh.join(base.select("block", "base"), "block").withColumn("rn", rn)
    return keywords.select("id", "name").unionByName(numbered.select((F.lit(top) + F.col("base") + F.col("rn")).cast("bigint").alias("id"), "name"))


def mapping(article_keywords: DataFrame) -> DataFrame:
    """Distinct links; those with a null drop out."""
    return article_keywords.select("article_id", "keyword_id").dropna().distinct()


def replaced(current: DataFrame, updates: DataFrame, keywords: DataFrame) -> DataFrame:
    """article_id, keyword_id after ``updates`` (article_id, names array or null): null leaves an
    article's links, an empty list clears them, names replace them."""
    touched = updates.filter("names is not null").select("article_id").distinct()
    keep = mapping(current).join(touched, "article_id", "left_anti")
    names = updates.select("article_id", F.explode("names").alias("n")).select("article_id", strip_control(F.col("n")).alias("name")).filter("name <> ''")
    ids = keywords.groupBy("name").agg(F.min("id").alias("keyword_id"))
    return keep.unionByName(names.join(ids, "name").select("article_id", "keyword_id").distinct())


def created_and_replaced(current: DataFrame, updates: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary with the names of ``updates`` it lacked, and the links after the updates."""
    names = updates.select(F.explode("names").alias("name"))
    dictionary = stage(upserted(names, keywords), "dictionary")
    return dictionary, replaced(current, updates, dictionary)


def updated_summaries(articles: DataFrame, updates: DataFrame) -> DataFrame:
    """id, summary: the new summary where there is one."""
    new = updates.select(F.col("article_id").alias("id"), F.col("summary").alias("new"))
    return articles.select("id", "summary").join(new, "id", "left").select("id", F.coalesce("new", "summary").alias("summary"))
