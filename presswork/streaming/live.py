"""Structured Streaming forms: reaction state, counters, job progress with expiry, access log.

``available_now`` runs a stream over what is there and stops, so it can be held against the batch
form. State lives in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from presswork.operators.emotions import final_states
from presswork.session import shared_dir, ship


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A Parquet table as a stream of its files."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*").parquet(f"{sf_dir}/{name}.parquet*")


def _toggle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the standing reaction ('' for none); requests are taken in (ts, seq) order within
    a micro-batch, micro-batches in the order they come."""
    now = state.get[0] if state.exists else ""
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
    for e in rows["emotion_type"]:
        now = "" if now == e else e
    state.update((now,))
    yield pd.DataFrame({"article_id": [key[0]], "user_identifier": [key[1]], "emotion_type": [now], "last_seq": [int(rows["seq"].iloc[-1])]})


def reaction_states(log: DataFrame) -> DataFrame:
    """article_id, user_identifier, emotion_type ('' for none), last_seq after each micro-batch."""
    out = "article_id bigint, user_identifier bigint, emotion_type string, last_seq bigint"
    return log.groupBy("article_id", "user_identifier").applyInPandasWithState(_toggle, out, "emotion_type string", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, emotion_type, n: tumbling windows, for a stream in about the order of time; rows later than
    ``late`` are left out by the watermark (``left_out`` counts them). ``fold_daily`` takes any order."""
    d = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return d.groupBy(F.window("at", width).alias("w"), "emotion_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "emotion_type", "n")


def left_out(log: DataFrame, counts: DataFrame) -> int:
    """How many rows of ``log``, the whole table that was streamed, ``windowed_counts`` hasn't counted."""
    return log.count() - (counts.agg(F.sum("n")).first()[0] or 0)


def _progress(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": ["GONE"], "progress": [-1]})
        return
    now, at, seq = state.get if state.exists else (None, None, -1)
    status = now
    for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
        status, at, seq = r.status, int(r.progress), int(r.seq)
    state.update((status, at, seq))
    if status in ("DONE", "FAILED"):
        state.setTimeoutDuration(180_000)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [at]})


def progress_states(log: DataFrame) -> DataFrame:
    """job_id, status, progress: the last snapshot of each job, forgotten three minutes after its end."""
    return log.groupBy("job_id").applyInPandasWithState(_progress, "job_id bigint, status string, progress bigint", "status string, progress bigint, seq bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def available_now(stream: DataFrame, mode: str, keys: list[str] | None = None, shuffle: int | None = None) -> DataFrame:
    """Run to the end of what is there. Each micro-batch is written to the shared folder under its
    number, so a repeated one replaces itself; the result has, per key, the row of the last batch
    ('update'), or all rows ('append'), or those of the last batch ('complete')."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/b={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(f"{_ddl(stream)}, __batch int").parquet(f"{base}/out/b=*")
    if mode == "complete":
        last = got.agg(F.max("__batch")).first()[0]
        return got.filter(F.col("__batch") == F.lit(last)).drop("__batch")
    if mode == "append" or not keys:
        return got.drop("__batch")
    rest = [c for c in stream.columns if c not in keys]
    top = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
    return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def folded_now(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """A keyed state table that each micro-batch is folded into, as a DataFrame operation.

    ``fold`` gets the table so far (None at first) and the batch. Every batch writes a version of
    its own from the one before it, so a batch that is repeated after a failure gives the same
    version again. Millions of keys cost a join, not a Python call each."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    versions: list[int] = []

    def step(df: DataFrame, batch: int) -> None:
        before = [v for v in versions if v < batch]
        prev = df.sparkSession.read.parquet(f"{base}/v{before[-1]}") if before else None
        fold(prev, df).write.mode("overwrite").parquet(f"{base}/v{batch}")
        if batch not in versions:
            versions.append(batch)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/v{versions[-1]}")


def fold_reactions(prev: DataFrame | None, log: DataFrame) -> DataFrame:
    """Standing reactions after a batch of requests: what stood before comes as a request of its own."""
    if prev is not None:
        first = F.lit("0001-01-01").cast("timestamp_ntz")
        seeds = prev.select(F.lit(-1).cast("bigint").alias("seq"), "article_id", "user_identifier", "emotion_type", first.alias("ts"))
        log = seeds.unionByName(log.select("seq", "article_id", "user_identifier", "emotion_type", F.col("ts").cast("timestamp_ntz").alias("ts")))
    return final_states(log)


def fold_progress(prev: DataFrame | None, log: DataFrame) -> DataFrame:
    """Last snapshot of each job after a batch."""
    cols = ["job_id", "ts", "seq", "status", "progress"]
    rows = log.select(*cols) if prev is None else prev.select(*cols).unionByName(log.select(*cols))
    top = rows.groupBy("job_id").agg(F.max(F.struct("ts", "seq", "status", "progress")).alias("m"))
    return top.select("job_id", "m.ts", "m.seq", "m.status", "m.progress")


def fold_daily(prev: DataFrame | None, events: DataFrame) -> DataFrame:
    """start, emotion_type, n: rows of each day so far, whatever order they come in."""
    n = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("emotion_type")).agg(F.count("*").alias("n"))
    return n if prev is None else prev.unionByName(n).groupBy("start", "emotion_type").agg(F.sum("n").alias("n"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
