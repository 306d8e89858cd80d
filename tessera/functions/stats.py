"""Statistics as columns and as plans over grouped rows.

Means and quantiles of nothing are 0; rates and correlations of nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranges


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """The exact quantile with linear interpolation, q held within 0 and 1."""
    return F.coalesce(F.percentile(x.cast("double"), F.lit(min(max(q, 0.0), 1.0))), F.lit(0.0))


def summary(x: Column, prefix: str) -> list[Column]:
    """Mean, 10th, 50th and 90th percentile, maximum."""
    return [
        mean(x).alias(f"{prefix}_mean"), *[quantile(x, q).alias(f"{prefix}_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
        F.coalesce(F.max(x.cast("double")), F.lit(0.0)).alias(f"{prefix}_max"),
    ]


def rate(flag: Column) -> Column:
    """The share of true among known values; null where none is known."""
    return F.avg(flag.cast("double"))


def entropy(p: Column) -> Column:
    """Shannon entropy of the positive values, in nats."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.ln(p))), F.lit(0.0))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def pearson(x: Column, y: Column) -> Column:
    """Null below three pairs, on a constant side or a value that is not finite; within -1 and 1."""
    x, y = x.cast("double"), y.cast("double")
    sound = (F.count(F.lit(1)) >= 3) & F.bool_and(finite(x) & finite(y)) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(sound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))))


def with_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """1-based ranks, ties sharing their average.

    Counts of distinct values are ranked, not rows, so a value that many rows share costs one row. Groups are windows of
    distinct values; without groups ranks come by ranges, in many tasks. Rows without a value are left out.
    """
    keys = by or []
    if not keys:
        return df.join(ranges.ranks(df, value, name, []), value)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0).drop("_n")
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = with_ranks(with_ranks(df, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Mann-Whitney area under the curve by group; null where a class is empty."""
    if not by:
        return ranges.area(df, score, label, by)
    ranked = with_ranks(df, score, "_rank", by)
    positive = F.count_if(F.col(label))
    negative = F.count_if(~F.col(label))
    u = F.sum(F.when(F.col(label), F.col("_rank"))) - positive * (positive + 1) / 2.0
    return ranked.groupBy(*by).agg(F.when((positive > 0) & (negative > 0), F.try_divide(u, (positive * negative).cast("double"))).alias("auroc"))


def line(x: Column, y: Column) -> list[Column]:
    """Least squares of y on x: slope, intercept and r squared; null below two distinct x. A constant y fits fully."""
    x, y = x.cast("double"), y.cast("double")
    sound = F.max(x) > F.min(x)
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return [
        F.when(sound, slope).alias("slope"), F.when(sound, F.avg(y) - slope * F.avg(x)).alias("intercept"),
        F.when(sound, F.when(F.max(y) > F.min(y), F.try_divide(F.pow(F.covar_pop(x, y), 2), F.var_pop(x) * F.var_pop(y))).otherwise(1.0)).alias("r2"),
    ]


def bins(df: DataFrame, confidence: str, correct: str, number: int = 10) -> DataFrame:
    """Reliability bins of equal width, the last one closed: bin, n, confidence, accuracy; and the weight each has in the error.

    Values outside 0 and 1 fall in no bin and still count in the total.
    """
    inside = F.col(confidence).between(0, 1)
    found = df.groupBy(F.when(inside, F.least(F.floor(F.col(confidence) * number), F.lit(number - 1))).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), rate(F.col(correct)).alias("accuracy")
    )
    total = found.agg(F.sum("n").alias("total"))
    every = df.sparkSession.range(number).select(F.col("id").cast("int").alias("bin"))
    # The total is one row.
    joined = every.join(found.where("bin IS NOT NULL"), "bin", "left").join(F.broadcast(total))
    return joined.select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.col("n") / F.greatest(F.col("total"), F.lit(1)) * F.abs(F.col("accuracy") - F.col("confidence")), F.lit(0.0)).alias("error"),
    )


def upper_median(x: Column) -> Column:
    """The upper of the middle values, of a bounded group."""
    ordered = F.array_sort(F.collect_list(x))
    return F.try_element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)


def buckets(df: DataFrame, order: list[str], value: str, number: int, by: list[str]) -> DataFrame:
    """A series averaged into at most `number` buckets by position."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.groupBy(*by, F.floor(F.col("_i") * number / F.greatest(F.col("_n"), F.lit(number))).cast("int").alias("bucket")).agg(F.avg(value).alias("value"))
