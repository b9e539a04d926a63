"""Session and table access shared by the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`; any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LOCAL: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the folder that all executors share (spark.checkpoint.dir) and read back, which cuts its lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        _LOCAL[:] = _LOCAL or [tempfile.mkdtemp(prefix="registrum-")]
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the staged table behind df, which no later plan may read."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
