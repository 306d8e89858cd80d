"""Order statistics of groups of any size, exactly and over many tasks: no window and no buffer holds a group.

Running counts go over distinct values, dealt out in ranges of the order: sums of the ranges, of which there are as many as
partitions, give each its beginning. A quantile is found by selection: a sketch of bounded size brackets it, a scan counts what
lies below, and running counts over the bracket alone find the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: Accuracy of the sketch that brackets quantiles: ranks are off by one in so many at most, and its size is in proportion.
ACCURACY = 10_000


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """`a` with the rows of `b` for its keys, where null equals null; of no keys, with the one row of `b`."""
    if not keys:
        return a.crossJoin(F.broadcast(b.limit(1)))
    named = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return a.join(named, on, "left").drop(*[f"_right_{k}" for k in keys])


def running(counts: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """`counts` with `before_<c>` for each of `sums`: its sum over the group's rows that come earlier in the order.

    Rows of a group differ in `order`. Groups and orders are cut into ranges together, so that a large group is many of them.
    """
    scratch = Scratch(counts.sparkSession, "ranges")
    dealt = scratch.save(counts.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "counts")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    firsts = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_first_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    found = same(placed, firsts, [*by, "_part"])
    return found.select(*counts.columns, *[(F.col(f"_first_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums])


def ranks(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """Average ranks, from 1, of a group's distinct values that are not null: by, value, name."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, by, value, ["n"]).select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(name))


def area(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Mann-Whitney area under the curve from counts of each score: by, auroc; null where a class is empty."""
    yes, no = F.count_if(F.col(label)), F.count_if(~F.col(label))
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(yes.alias("yes"), no.alias("no"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # Twice the pairs that the positives win, ties as half: whole numbers.
    won = running(counts, by, score, ["no"]).withColumn("_won", (big("yes") * (2 * big("before_no") + big("no"))).cast("decimal(38,0)"))
    sums = won.groupBy(*by).agg(F.sum("_won").cast("double").alias("_won"), F.sum("yes").cast("double").alias("_yes"), F.sum("no").cast("double").alias("_no"))
    return sums.select(*by, F.when((F.col("_yes") > 0) & (F.col("_no") > 0), F.col("_won") / 2 / F.col("_yes") / F.col("_no")).alias("auroc"))


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation, a row for each group: by, and a column for each of `qs`.

    Nulls are left out; NaN is larger than any number; a group without values has no row, and without groups the one row is
    then null. Quantiles are held within 0 and 1.
    Where a bracket should not hold its quantile, the whole group is taken for one.
    """
    by = by or []
    qs = {name: min(max(float(q), 0.0), 1.0) for name, q in qs.items()}
    scratch = Scratch(df.sparkSession, "quantiles")
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*by, v.alias("_v"))
    margin = 3.0 / accuracy
    sketch = F.percentile_approx("_v", [min(max(q + d, 0.0), 1.0) for q in qs.values() for d in (-margin, margin)], accuracy)
    few = F.count(F.lit(1)) <= accuracy
    low, high = F.min("_v"), F.max("_v")
    told = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_s"), few.alias("_few"), low.alias("_low"), high.alias("_high")).where("_n > 0")
    told = scratch.save(told, "sketch")

    def found(told: DataFrame, whole: Column, label: str) -> DataFrame:
        """A row for each group and quantile: the values at its two ranks, if its bracket holds them."""
        brackets = F.array(*[F.struct(
            F.lit(k).alias("q"), F.when(whole, F.col("_low")).otherwise(F.col("_s")[2 * k]).alias("a"), F.when(whole, F.col("_high")).otherwise(F.col("_s")[2 * k + 1]).alias("b"),
        ) for k in range(len(qs))])
        asked = told.select(*by, brackets.alias("_brackets"))
        met = same(rows, asked, by).select(*by, "_v", F.explode("_brackets").alias("_x")).select(*by, F.col("_x.q").alias("_q"), F.when(F.col("_v") >= F.col("_x.a"), F.col("_v")).alias("_v"), F.col("_x.b").alias("_b"))
        # What lies below the bracket is one row, null, and counts; what lies above is left out.
        counts = met.where("_v IS NULL OR _v <= _b").groupBy(*by, "_q", "_v").agg(F.count(F.lit(1)).alias("n"))
        placed = running(counts, [*by, "_q"], "_v", ["n"]).where("_v IS NOT NULL")
        wanted = told.select(*by, F.col("_n"), F.explode(F.array(*[F.struct(F.lit(k).alias("_q"), (F.lit(q) * (F.col("_n") - 1)).alias("_p")) for k, q in enumerate(qs.values())])).alias("_w")).select(*by, "_w.*")
        met = same(placed, wanted, [*by, "_q"])
        holds = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
        first = F.max(F.when(holds(F.floor("_p")), F.col("_v"))).alias("_first")
        return scratch.save(met.groupBy(*by, "_q", "_p").agg(first, F.max(F.when(holds(F.ceil("_p")), F.col("_v"))).alias("_second")), label)

    held = found(told, F.col("_few"), "held")
    lost = held.where("_first IS NULL OR _second IS NULL")
    if held.count() < told.count() * len(qs) or not lost.isEmpty():
        held = found(told, F.lit(True), "whole")
    between = F.when(F.col("_first") == F.col("_second"), F.col("_first")).otherwise(F.col("_first") + (F.col("_p") - F.floor("_p")) * (F.col("_second") - F.col("_first")))
    return held.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == k, between)).alias(name) for k, name in enumerate(qs)])
