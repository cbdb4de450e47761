"""Table access: Parquet by default, JDBC as an option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC; with ``column`` it is read in ``parts`` ranges at once."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()
