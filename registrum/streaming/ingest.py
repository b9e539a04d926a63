"""Entities from files as they arrive: each micro-batch is added beside the earlier ones, and the newest row of a key counts.

A batch writes its own rows and nothing else, however large the table is; a batch that is tried again replaces what it wrote before, so each counts
once. current() reads the table as of now, compacted() folds its batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from registrum.operators.linkage import first_wins
from registrum.sources.store import swap


def ingest(spark: SparkSession, folder: str, schema: str, path: str, checkpoint: str, key: str = "uid", order: str | None = None) -> StreamingQuery:
    """Starts a query that takes the JSON files there now and ends; run again, it takes only newer ones. Of a batch's rows of a key the last by `order`
    stays (none given: by a hash of the row, the same in every run)."""

    def take(batch: DataFrame, number: int) -> None:
        turn = F.col(order) if order else F.xxhash64(*batch.columns)
        rows = first_wins(batch, [key], [turn.desc()]).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    rows = spark.readStream.schema(schema).json(folder)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str = "uid") -> DataFrame:
    """The newest row of every key."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "batch").alias("e")).select("e.*")


def compacted(spark: SparkSession, path: str, key: str = "uid") -> None:
    """Folds all batches into the newest one; not while a query writes."""
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    swap(current(spark, path, key).withColumn("batch", F.lit(newest)), path, "batch")
