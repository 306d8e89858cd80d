"""Training ledgers: per-partition, per-fact and per-epoch measures of loss and entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import mean, quantile, rate

#: A position with less loss than this is memorised.
MEMORISED = 0.1


def partition_stats(losses: DataFrame, parts: DataFrame, row: str = "row") -> DataFrame:
    """Positions, mean, largest and 90th percentile loss, mean entropy and memorised share of every partition; null where it has none.

    losses: a row for each position, or one for each partition with the lists of its losses and entropies. Rows are sorted by
    partition in each task; lists are measured where they are. A partition in several lists has the positions of all.

    The mean loss is the exact sum of the losses to fifteen places over their number, so that it doesn't depend on the order
    of the rows; losses that aren't finite numbers below 1e12 make it the plain average.
    """
    if losses.schema["loss"].dataType.typeName() == "array":
        if losses.groupBy(row).count().where("count > 1").isEmpty():
            return parts.select(row).join(listed_stats(losses, row), row, "left")
        losses = losses.select(row, F.explode(F.arrays_zip("loss", "entropy")).alias("_p")).select(row, "_p.loss", "_p.entropy")
    loss = F.col("loss").cast("double")
    exact = F.when(F.count_if(~(F.abs(loss) < 1e12)) > 0, F.avg(loss)).otherwise(F.sum(loss.try_cast("decimal(28,15)")).cast("double") / F.count(loss))
    found = losses.groupBy(row).agg(
        F.count(F.lit(1)).alias("positions"), exact.alias("mean_loss"), F.avg("entropy").alias("mean_entropy"), F.max("loss").alias("max_loss"),
        F.percentile("loss", F.lit(0.9)).alias("p90_loss"), rate(F.col("loss") < MEMORISED).alias("memorised"),
    )
    return parts.select(row).join(found, row, "left")


def listed_stats(losses: DataFrame, row: str) -> DataFrame:
    """The measures of `partition_stats` of partitions whose losses and entropies are lists; no position becomes a row."""
    known = lambda x: F.filter(x.cast("array<double>"), lambda v: v.isNotNull())
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    places = F.aggregate("_loss", F.lit(0).cast("decimal(37,15)"), lambda s, v: (s + v.try_cast("decimal(28,15)")).cast("decimal(37,15)"))
    held = lambda x: F.when(F.size(x) > 0, F.size(x))
    n = held("_loss")
    at = (n - 1) * F.lit(0.9)
    low, high = F.get("_loss", F.floor(at).cast("int")), F.get("_loss", F.ceil(at).cast("int"))
    some = losses.select(row, held("loss").cast("long").alias("positions"), F.sort_array(known(F.col("loss"))).alias("_loss"), known(F.col("entropy")).alias("_entropy"))
    measured = [
        F.when(F.exists("_loss", lambda v: ~(F.abs(v) < 1e12)), total("_loss") / n).otherwise(places.cast("double") / n).alias("mean_loss"),
        (total("_entropy") / held("_entropy")).alias("mean_entropy"), F.get("_loss", n - 1).alias("max_loss"),
        F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("p90_loss"),
        (F.size(F.filter("_loss", lambda v: v < MEMORISED)) / n).alias("memorised"),
    ]
    return some.select(row, "positions", *measured)


def memorised_share(loss: Column) -> Column:
    return mean((loss < MEMORISED).cast("double"))


def all_memorised(losses: Column) -> Column:
    """Every loss of an answer is below the bar: none of no losses fails, one that is not a number does."""
    return F.forall(losses, lambda x: (x < MEMORISED) & ~F.isnan(x))


def by_value_position(losses: DataFrame) -> DataFrame:
    """The loss of each value position; the last write counts."""
    return losses.groupBy("row", "offset").agg(F.max_by("loss", "seq").alias("loss"))


def fact_losses(facts: DataFrame, losses: DataFrame) -> DataFrame:
    """The losses of each fact's answer tokens in order, NaN where there is none: fact, losses, mean, memorised."""
    at = facts.select("fact", "row", F.posexplode(F.sequence("first", F.col("last") - 1)).alias("i", "offset"))
    joined = at.join(losses.select("row", "offset", "loss"), ["row", "offset"], "left")
    pair = F.struct("i", F.coalesce("loss", F.lit(float("nan"))).alias("loss"))
    rows = joined.groupBy("fact").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["loss"]).alias("losses"))
    return rows.withColumn("memorised", all_memorised(F.col("losses")))


def memorised_at(epochs: DataFrame, key: str, share: str = "memorised", bar: float = 0.95) -> DataFrame:
    """The first epoch at which a partition reached the bar, carried forward."""
    w = Window.partitionBy(key).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return epochs.withColumn("memorised_at", F.min(F.when(F.col(share) >= bar, F.col("epoch"))).over(w))


def steps_to(epochs: DataFrame, run: str, share: str, bar: float) -> DataFrame:
    """Steps until a run's memorised share first reached a bar; null if it never did."""
    w = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    total = epochs.withColumn("_steps", F.sum("steps").over(w))
    return total.groupBy(run).agg(F.min(F.when(F.col(share) >= bar, F.col("_steps"))).alias("steps"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last known value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def entropy_summary(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    from tessera.functions.stats import summary

    return rows.groupBy(*by).agg(*summary(F.col(x), x))


def masked_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean loss over scored positions; NaN where nothing is scored."""
    total = F.sum("mask")
    return rows.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("loss") * F.col("mask")) / total).otherwise(F.lit(float("nan"))).alias("loss"))


def marginal_cost(runs: DataFrame, key: str) -> DataFrame:
    """Seconds a token costs: the difference of a long and a short run of each prompt, on average."""
    wide = runs.groupBy(key).agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for k in ("long", "short") for c in ("seconds", "tokens")])
    return wide.agg(F.avg(F.try_divide(F.col("seconds_long") - F.col("seconds_short"), (F.col("tokens_long") - F.col("tokens_short")).cast("double"))).alias("cost"))


def activity(weights: DataFrame, by: list[str]) -> DataFrame:
    """How far parameters moved relative to their size, as a part of the one that moved most."""
    d = F.col("now") - F.col("before")
    moved = weights.groupBy(*by).agg(F.sqrt(F.sum(d * d) / F.greatest(F.sum(F.col("before") * F.col("before")), F.lit(1e-12))).alias("moved"))
    return moved.withColumn("activity", F.coalesce(F.try_divide(F.col("moved"), F.max("moved").over(Window.partitionBy())), F.lit(0.0)))


def p90(x: Column) -> Column:
    return quantile(x, 0.9)
