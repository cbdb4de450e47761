"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.sources.tables import table

#: Reaction requests of the event table, and each with what it does, as SQL.
LOG = "log as (select event_id seq, try_cast(json_extract_string(props, '$.k') as bigint) article_id, user_id user_identifier, event_type emotion_type, ts from events)"
TOGGLED = f"""with {LOG},
r as (select *, row_number() over (partition by article_id, user_identifier order by ts, seq) - row_number() over (partition by article_id, user_identifier, emotion_type order by ts, seq) run from log),
p as (select *, row_number() over (partition by article_id, user_identifier, emotion_type, run order by ts, seq) % 2 = 1 is_on from r),
t as (select *, lag(emotion_type) over w prev, lag(is_on) over w prev_on, row_number() over (partition by article_id, user_identifier order by ts desc, seq desc) back from p
 window w as (partition by article_id, user_identifier order by ts, seq))"""

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a directory, read when they are asked for: ``t.articles``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def note(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, d: f(Tables(spark, d))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return note
