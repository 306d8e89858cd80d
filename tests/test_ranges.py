import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import ranges, stats


def average_ranks(xs):
    ordered = sorted(xs)
    first, count = {}, {}
    for k, x in enumerate(ordered):
        first.setdefault(x, k)
        count[x] = count.get(x, 0) + 1
    return {x: first[x] + (count[x] + 1) / 2 for x in first}


def numbers(kind, n, r):
    return {
        "even": [r.random() for _ in range(n)], "ties": [float(r.randrange(5)) for _ in range(n)], "hot": [7.0 if r.random() < 0.6 else r.gauss(0, 100) for _ in range(n)],
        "powers": [math.copysign(2.0 ** r.uniform(-300, 300), r.random() - 0.5) for _ in range(n)], "one": [3.5] * n,
    }[kind]


QS = {f"q{k}": q for k, q in enumerate([0.0, 0.013, 0.25, 0.5, 0.9, 0.9999, 1.0, -3.0, 8.0])}


@pytest.mark.parametrize("kind", ["even", "ties", "hot", "powers", "one"])
def test_quantiles(spark, kind):
    """By selection from a coarse sketch, of one group and of several."""
    r = random.Random(kind)
    rows = [(g, x) for g, n in (("x", 3000), ("y", 1), ("z", 2), (None, 40)) for x in numbers(kind, n, r)] + [("x", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = lambda xs: [float(np.percentile(np.array(xs), 100 * min(max(q, 0), 1))) for q in QS.values()]
    got = ranges.quantiles(df, "v", QS, accuracy=100).collect()
    assert len(got) == 1 and list(got[0]) == pytest.approx(want([x for _, x in rows if x is not None]), rel=1e-9)
    grouped = {r["g"]: [r[c] for c in QS] for r in ranges.quantiles(df, "v", QS, ["g"], accuracy=100).collect()}
    assert set(grouped) == {"x", "y", "z", None}
    for g, found in grouped.items():
        assert found == pytest.approx(want([x for h, x in rows if h == g and x is not None]), rel=1e-9)


def test_a_bracket_that_misses(spark, monkeypatch):
    """With a sketch that is wrong the whole group is looked at, and the quantile is right all the same."""
    monkeypatch.setattr(F, "percentile_approx", lambda c, qs, n: F.array(*[F.lit(1e9) for _ in qs]))
    df = spark.range(2000).select(F.col("id").cast("double").alias("v"))
    got = ranges.quantiles(df, "v", {"m": 0.5, "t": 0.75}, accuracy=50).first()
    assert (got["m"], got["t"]) == (999.5, 1499.25)


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert ranges.quantiles(df.limit(0), "v", {"m": 0.5}).first()["m"] is None and ranges.quantiles(df.limit(0).withColumn("g", F.lit(1)), "v", {"m": 0.5}, ["g"]).count() == 0
    assert ranges.quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.0


@pytest.mark.parametrize("kind", ["even", "ties", "hot"])
def test_ranks_and_area(spark, kind):
    r = random.Random(kind)
    rows = [(g, x, r.random() < 0.3) for g, n in (("x", 900), ("y", 60), (None, 30)) for x in numbers(kind, n, r)] + [("x", None, True), ("x", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, l boolean").repartition(7)
    for by in ([], ["g"]):
        found = {(x["g"] if by else None, x["v"]): x["k"] for x in ranges.ranks(df, "v", "k", by).collect()}
        areas = {x["g"] if by else None: x["auroc"] for x in ranges.area(df, "v", "l", by).collect()}
        for g in {g for g, _ in found}:
            own = [x for x in rows if (not by or x[0] == g) and x[1] is not None]
            assert {v: k for (h, v), k in found.items() if h == g} == average_ranks([x[1] for x in own])
            own = [x for x in own if x[2] is not None]
            yes, no = [x[1] for x in own if x[2]], [x[1] for x in own if not x[2]]
            assert areas[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no), abs=1e-12)
    assert ranges.area(df.where("l"), "v", "l", []).first()["auroc"] is None


def test_statistics_without_groups_use_ranges(spark):
    r = random.Random(2)
    rows = [(float(r.randrange(30)), r.random(), r.random() < 0.5) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, l boolean")
    ranks = [average_ranks([row[k] for row in rows]) for k in (0, 1)]
    pairs = np.array([[ranks[0][a], ranks[1][b]] for a, b, _ in rows])
    assert stats.spearman(df, "x", "y", []).first()["spearman"] == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9)
    grouped = stats.auroc(df.withColumn("g", F.lit(1)), "y", "l", ["g"]).first()["auroc"]
    assert stats.auroc(df, "y", "l", []).first()["auroc"] == pytest.approx(grouped, abs=1e-12)


def test_no_window_holds_a_group(spark):
    """In the plan, windows over values are cut by range; the only ones over a whole group run over its ranges."""
    df = spark.range(10_000).select((F.col("id") % 977).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("l"))
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    plan = ranges.running(counts, [], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    assert len(windows) == 2
    for w in windows:
        assert "_part" in w
    over_values = [w for w in windows if re.search(r"\[v#\d+ ASC", w)]
    assert len(over_values) == 1 and re.search(r"\], \[_part#\d+\], \[v#\d+ ASC", over_values[0])


def test_ranges_are_many(spark):
    """A single group of distinct values lies in as many ranges as there are partitions, of even size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).select(F.col("id").alias("v"), F.lit(1).alias("n"))
        assert ranges.running(counts, [], "v", ["n"]).where("before_n <> v").count() == 0
        dealt = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert len(dealt) == 4 and max(r["count"] for r in dealt) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_by_flag_hold_no_group(spark, tmp_path):
    from tessera.registry import queries

    rows = [("A", float(i)) for i in range(101)] + [("B", None), (None, 4.0), (None, 6.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries()["quantile_linear"](spark, str(tmp_path))
    assert "percentile(" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["l_returnflag"]: (r["q10"], r["q50"], r["q90"]) for r in found.collect()}
    assert got == {"A": (10.0, 50.0, 90.0), "B": (None, None, None), None: (4.2, 5.0, 5.8)}
