"""Writes as new tables: rows with ids, rows unless they are there, updates with their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as tx

BLOCKS = 1024


def with_ids(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ids that continue the greatest one of ``table``, in hash blocks: counts of the
    blocks are brought together, not the rows. Repeated rows get an id each. The ids are gapless;
    which row gets which isn't defined."""
    cols = [c for c in rows.columns if c != key]
    d = rows.select(*cols).withColumn("__block", F.pmod(F.xxhash64(*cols), F.lit(BLOCKS)).cast("int"))
    size = d.groupBy("__block").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # over at most BLOCKS rows
    base = size.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    rn = F.row_number().over(Window.partitionBy("__block").orderBy(*cols))
    return d.join(F.broadcast(base), "__block").select((F.lit(top) + F.col("__base") + rn).cast("bigint").alias(key), *cols)


def inserted(table: DataFrame, rows: DataFrame, **defaults: Column) -> DataFrame:
    """``table`` and ``rows`` under new ids; columns that the rows lack are null or their default."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    fresh = with_ids(rows, table)
    return table.unionByName(fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def inserted_unless(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``inserted`` with those rows whose ``key`` isn't null and isn't in the table yet, one a key."""
    there = table.select(key).filter(F.col(key).isNotNull()).distinct()
    fresh = rows.filter(F.col(key).isNotNull()).join(there, key, "left_anti").dropDuplicates([key])
    return inserted(table, fresh)


def updated(table: DataFrame, changes: DataFrame, now: Column | None = None, key: str = "id") -> DataFrame:
    """``table`` with the columns of ``changes`` (key and new values) set in the rows it names, a null
    included; ``updated_at`` of those rows is ``now`` if both are there. An id may stand in one change
    only."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key), F.lit(True).alias("__hit"))
    d = table.join(new, key, "left")
    hit = F.col("__hit").isNotNull()
    cols = []
    for c in table.columns:
        if c != key and c in changes.columns:
            cols.append(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and now is not None:
            cols.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return d.select(*cols)


def key_or_null(key: Column, value: Column) -> Column:
    """``value``, null for a key without text."""
    return F.when(tx.has_text(key), value)


def row_or_error(table: DataFrame, id_: int, key: str = "id") -> DataFrame:
    """The rows of an id; LookupError if there is none."""
    d = table.filter(F.col(key) == id_)
    if not d.limit(1).count():
        raise LookupError(f"{key} {id_}")
    return d


def related_rows(hits: DataFrame, batch: Column, status: str | None = None) -> DataFrame:
    """Related rows as they are stored: with ``batch_date`` and, of policies, a status."""
    d = hits.withColumn("batch_date", batch)
    return d.withColumn("status", F.lit(status)) if status is not None else d
