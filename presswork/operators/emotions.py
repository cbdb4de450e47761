"""Reactions: toggling per (article, user), counts per article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The reaction types of the event table, in this order in zero-filled counts.
EMOTIONS = ["click", "error", "purchase", "signup", "view"]


def emotion_log(events: DataFrame) -> DataFrame:
    """seq, article_id, user_identifier, emotion_type, ts from the event table."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select(F.col("event_id").alias("seq"), k.alias("article_id"), F.col("user_id").alias("user_identifier"), F.col("event_type").alias("emotion_type"), "ts").filter("article_id is not null and user_identifier is not null")


def toggled(log: DataFrame) -> DataFrame:
    """Each request with ``on`` (it sets the reaction) and what it replaced.

    The same reaction again takes it back, another one replaces it. Inside a run of equal requests
    odd positions set and even ones take back, as a run always begins in another state. Requests
    are ordered by (ts, seq), so ties in time have an order."""
    key = ["article_id", "user_identifier"]
    w = Window.partitionBy(*key).orderBy("ts", "seq")
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, "emotion_type").orderBy("ts", "seq"))
    d = log.withColumn("run", run)
    pos = F.row_number().over(Window.partitionBy(*key, "emotion_type", "run").orderBy("ts", "seq"))
    d = d.withColumn("on", pos % 2 == 1)
    before, was_on = F.lag("emotion_type").over(w), F.lag("on").over(w)
    return d.withColumn("replaced", F.when((before != F.col("emotion_type")) & was_on, before)).drop("run")


def final_states(log: DataFrame) -> DataFrame:
    """article_id, user_identifier, emotion_type of the reactions that stand."""
    w = Window.partitionBy("article_id", "user_identifier").orderBy(F.col("ts").desc(), F.col("seq").desc())
    last = toggled(log).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return last.filter("on").select("article_id", "user_identifier", "emotion_type")


def responses(log: DataFrame) -> DataFrame:
    """seq, article_id, on, count: what each request is answered, with the running count of its
    reaction on its article."""
    t = toggled(log)
    own = t.select("seq", "ts", "article_id", "emotion_type", F.when(F.col("on"), 1).otherwise(-1).alias("delta"), F.lit(1).alias("own"), "on")
    gone = t.filter("replaced is not null").select("seq", "ts", "article_id", F.col("replaced").alias("emotion_type"), F.lit(-1).alias("delta"), F.lit(0).alias("own"), "on")
    w = Window.partitionBy("article_id", "emotion_type").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    all_ = own.unionByName(gone).withColumn("count", F.sum("delta").over(w).cast("bigint"))
    return all_.filter("own = 1").select("seq", "article_id", "on", "count")


def emotion_stats(articles: DataFrame, states: DataFrame) -> DataFrame:
    """article_id, n_<type> for every type (0 where none), n_total of the reactions that stand
    (``final_states``): one pass, partial sums first."""
    per = states.groupBy("article_id").agg(*(F.count_if(F.col("emotion_type") == e).alias(f"n_{e}") for e in EMOTIONS), F.count("*").alias("n_total"))
    cols = [f"n_{e}" for e in EMOTIONS] + ["n_total"]
    return articles.select(F.col("id").alias("article_id")).join(per, "article_id", "left").select("article_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols))


def own_emotion(states: DataFrame, user: int | None) -> DataFrame:
    """The standing reactions of one user; none for null."""
    return states.filter(F.col("user_identifier") == F.lit(user).cast("bigint")).select("article_id", "emotion_type")
