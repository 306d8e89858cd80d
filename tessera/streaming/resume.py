"""Streams that stop and go on: sinks in which a batch that comes again replaces itself, and what a checkpoint holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def once(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for `foreachBatch`: a batch is a partition of the table at `path`, written whole.

    After a stop the stream repeats the last batch if it doesn't know it committed; its partition is replaced, so that no row
    is there twice. `then` runs once the batch is written, and again if the batch is repeated.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if then:
            then(df, batch)

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that has one, in a table that `once` writes in update mode."""
    rows = spark.read.parquet(path)
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def state_of(spark: SparkSession, checkpoint: str, **options: str) -> DataFrame:
    """What a checkpoint holds for each key of a stream's stateful step: the columns of `key` and `value`, or of a named variable."""
    found = spark.read.format("statestore").options(**options).load(checkpoint)
    return found.select("key.*", "value.*") if "value" in found.columns else found
