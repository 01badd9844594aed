"""Sinks: a run's partition replaced as a whole, append-only tables, upserts and JSON dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_run(df: DataFrame, path: str) -> None:
    """Writes the runs in ``df`` (run_id), each replacing its own partition and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with the changes merged in: of each key the row of the highest order, changes before old rows."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_p", place).where("_p = 1").drop("_p", "_new")


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def alive(cache: DataFrame, now) -> DataFrame:
    """Cache entries that have not expired."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def missing(asked: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What the cache does not hold."""
    return asked.join(cache.select(key).distinct(), key, "left_anti")
