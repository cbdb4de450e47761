"""Access log: who is tracked, as whom, and how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import is_uuid

COOKIE = "user_uuid"


def is_tracked(path: Column) -> Column:
    return ~(path.startswith("/actuator") | path.startswith("/favicon") | path.startswith("/static"))


def is_logged(path: Column) -> Column:
    return path.startswith("/api/qr/")


def requests(events: DataFrame) -> DataFrame:
    """seq, uuid, path, access_time, is_new_user from the event table: views and clicks are issue
    reads, errors health probes, the rest article reads; a user's first event has no cookie yet."""
    k = F.get_json_object("props", "$.k")
    path = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("/api/qr/"), k)).when(F.col("event_type") == "error", F.lit("/actuator/health")).otherwise(F.concat(F.lit("/api/articles/"), k))
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("first_id"))
    d = events.join(first, "user_id")
    return d.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("uuid"), path.alias("path"), F.col("ts").alias("access_time"), (F.col("event_id") == F.col("first_id")).alias("is_new_user"))


def access_log(reqs: DataFrame) -> DataFrame:
    return reqs.filter(is_tracked(F.col("path")) & is_logged(F.col("path"))).select("seq", "uuid", "path", "access_time", "is_new_user")


def path_counts(reqs: DataFrame) -> DataFrame:
    return reqs.filter(is_tracked(F.col("path"))).groupBy("path").agg(F.count("*").alias("requests"))


def new_users(reqs: DataFrame) -> DataFrame:
    return access_log(reqs).agg(F.count_if("is_new_user").alias("new_users"))


def identity(cookies: DataFrame) -> DataFrame:
    """request_id, uuid, is_new_user: the first cookie of the name that holds a valid id, else a
    new one; new is who has no such cookie at all, whatever is in it. cookies: request_id, list
    array<struct<name, value>> (null: none)."""
    own = F.filter(F.coalesce("list", F.array().cast("array<struct<name:string,value:string>>")), lambda c: c["name"] == COOKIE)
    valid = F.filter(own, lambda c: is_uuid(c["value"]))
    return cookies.select("request_id", F.coalesce(F.get(valid, F.lit(0))["value"], F.uuid()).alias("uuid"), (F.size(own) == 0).alias("is_new_user"))
