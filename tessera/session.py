"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC, the engine's defaults."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: A table of less is dealt out over all cores, as a file of one row group is a single task whatever the cluster.
SMALL_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder. `spread` deals a small one out evenly, for work that is heavy by the row; a large one stays as it is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not spread:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else df
