"""Incremental runs over landed files: each micro-batch of claims is compared with the table of the run before, and the
latest state of every key is merged into it. An addition for large inputs; batch runs give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klarspan.operators import claims as C
from klarspan.sources import stores


def run_deltas(spark: SparkSession, landed: str, schema, state: str, out: str, checkpoint: str, files: int = 64):
    """A query that writes each batch's claim deltas to ``out`` and the merged claims to generations under ``state``."""

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{state}/gen={number - 1}") if number else batch.limit(0)
        C.claim_delta(batch, before).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        stores.upserted(before.select(*batch.columns), batch, ["source_type", "source_id", "subject_key", "predicate", "normalized_value"], "record_ord").write.mode("overwrite").parquet(f"{state}/gen={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by time window and type, for streams with late rows as for tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
