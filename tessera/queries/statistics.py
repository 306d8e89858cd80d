"""Statistics."""

from pyspark.sql import functions as F

from tessera.functions import ranges, stats
from tessera.session import table

from .base import query, rounded


@query("mean_empty_zero", "SELECT event_type, round(coalesce(avg(CASE WHEN value > 1e9 THEN value END), 0), 6) AS none, round(avg(value), 6) AS every FROM events GROUP BY 1")
def mean_empty_zero(spark, sf):
    e = table(spark, sf, "events")
    return rounded(e.groupBy("event_type").agg(stats.mean(F.when(F.col("value") > 1e9, F.col("value"))).alias("none"), stats.mean(F.col("value")).alias("every")))


@query("quantile_linear", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM lineitem GROUP BY 1")
def quantile_linear(spark, sf):
    """Three groups, whatever their size: no task holds one."""
    flags = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = ranges.quantiles(flags, "l_extendedprice", {f"q{int(q * 100)}": q for q in (0.1, 0.5, 0.9)}, ["l_returnflag"])
    # A group without a value has a row as well.
    return rounded(ranges.same(flags.select("l_returnflag").distinct(), found, ["l_returnflag"]))


@query("entropy_summary", "SELECT event_type, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.9), 6) AS value_p90, max(value) AS value_max FROM events GROUP BY 1")
def entropy_summary(spark, sf):
    from tessera.operators.ledger import entropy_summary as roll

    return rounded(roll(table(spark, sf, "events"), ["event_type"], "value"))


@query("avg_rank", "SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rank FROM documents")
def avg_rank(spark, sf):
    return stats.with_ranks(table(spark, sf, "documents"), "n_chars", "rank", ["lang"]).select("doc_id", F.col("rank").cast("double"))


PEARSON = "CASE WHEN count(*) >= 3 AND max({0}) > min({0}) AND max({1}) > min({1}) THEN round(greatest(-1, least(1, corr({0}, {1}))), 6) END"


@query("pearson_guarded", f"SELECT l_returnflag, {PEARSON.format('l_quantity', 'l_extendedprice')} AS r, CASE WHEN false THEN 0.0::DOUBLE END AS constant FROM lineitem GROUP BY 1")
def pearson_guarded(spark, sf):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(stats.pearson(x, y).alias("r"), stats.pearson(x, F.lit(1.0)).alias("constant")))


RANKED = "SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS {name} FROM {t}"


@query("spearman", f"WITH a AS ({RANKED.format(by='l_returnflag', x='l_quantity', name='rx', t='lineitem')}), b AS ({RANKED.format(by='l_returnflag', x='l_extendedprice', name='ry', t='a')}) SELECT l_returnflag, {PEARSON.format('rx', 'ry')} AS spearman FROM b GROUP BY 1")
def spearman(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("auroc", f"WITH j AS (SELECT lang, n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), r AS ({RANKED.format(by='lang', x='n_chars', name='rk', t='j')}) SELECT lang, CASE WHEN bool_or(good) AND bool_or(NOT good) THEN round((sum(rk) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 6) END AS auroc FROM r GROUP BY 1")
def auroc(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return rounded(stats.auroc(j, "n_chars", "good", ["lang"]))


WHOLE = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q90": 0.9, "q99": 0.999, "q100": 1.0}


@query("quantiles_whole", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in WHOLE.items()) + " FROM lineitem")
def quantiles_whole(spark, sf):
    """Quantiles of all lines as one group, by selection."""
    return rounded(ranges.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", WHOLE))


@query("auroc_whole", f"WITH j AS (SELECT l_extendedprice AS x, l_returnflag = 'R' AS good FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM j) SELECT round((sum(rk) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 6) AS auroc FROM r")
def auroc_whole(spark, sf):
    """How well a line's price tells that it was returned, over all lines."""
    return rounded(stats.auroc(table(spark, sf, "lineitem").withColumn("good", F.col("l_returnflag") == "R"), "l_extendedprice", "good", []))


@query("spearman_whole", f"WITH a AS (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) SELECT {PEARSON.format('rx', 'ry')} AS spearman FROM a")
def spearman_whole(spark, sf):
    """Rank correlation of quantity and price over all lines."""
    return rounded(stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", []))


@query("calibration_bins_ece", """WITH j AS (SELECT n_chars / 4000.0::DOUBLE AS c, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT CASE WHEN c BETWEEN 0 AND 1 THEN least(floor(c * 10), 9)::INT END AS bin, count(*) AS n, avg(c) AS confidence, avg(ok::INT) AS accuracy FROM j GROUP BY 1)
    SELECT r.i::INT AS bin, coalesce(n, 0) AS n, round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(n / (SELECT count(*) FROM j) * abs(accuracy - confidence), 0), 6) AS error FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i""")
def calibration_bins_ece(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select((F.col("n_chars") / 4000.0).alias("c"), (F.col("quality") == 1).alias("ok"))
    return rounded(stats.bins(j, "c", "ok"))


@query("ols_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_fit(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*stats.line(F.col("l_quantity"), F.col("l_extendedprice")))
    return rounded(f.withColumn("intercept", F.round("intercept", 4)), "slope", "r2")


@query("upper_median", "SELECT n_regionkey, list_sort(list(s_acctbal))[(count(*) // 2)::INT + 1] AS median FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def upper_median(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_regionkey").agg(stats.upper_median(F.col("s_acctbal")).alias("median"))


@query("downsample_buckets", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, floor(i * 24 / greatest(n, 24))::INT AS bucket, round(avg(value), 6) AS value FROM r GROUP BY 1, 2")
def downsample_buckets(spark, sf):
    return rounded(stats.buckets(table(spark, sf, "events"), ["ts", "event_id"], "value", 24, ["event_type"]))


@query("rollup_world", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def rollup_world(spark, sf):
    from tessera.operators.evaluate import by_world

    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return rounded(by_world(j, "lang", "good"))


@query("world_matrix_pivot", "PIVOT (SELECT source, lang, n_chars FROM documents) ON lang IN ('en', 'de', 'fr', 'es') USING round(avg(n_chars), 6) GROUP BY source")
def world_matrix_pivot(spark, sf):
    from tessera.operators.evaluate import matrix

    return rounded(matrix(table(spark, sf, "documents"), "source", "lang", ["en", "de", "fr", "es"], "n_chars"))


@query("opened_histogram", "WITH c AS (SELECT o_custkey, least(count(*), 20) AS k FROM orders GROUP BY 1), h AS (SELECT k, count(*) AS n FROM c GROUP BY 1) SELECT r.i AS value, coalesce(n, 0) AS n FROM range(21) r(i) LEFT JOIN h ON k = r.i")
def opened_histogram(spark, sf):
    from tessera.operators.evaluate import histogram

    return histogram(table(spark, sf, "orders").groupBy("o_custkey").agg(F.least(F.count(F.lit(1)), F.lit(20)).alias("k")), "k", 20)


@query("lr_schedules", """SELECT i AS step, round(CASE WHEN i < 100 THEN 0.001 * (i + 1) / 100.0::DOUBLE ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(greatest(0, least(1, (i - 100) / 900.0::DOUBLE)) * 3.141592653589793)) END, 9) AS cosine,
    round(CASE WHEN i < 100 THEN 0.001 * (i + 1) / 100.0::DOUBLE WHEN 1000 - i > 200 THEN 0.001 ELSE 0.001 * greatest(0, least(1, (1000 - i) / 200.0::DOUBLE)) END, 9) AS stable FROM (SELECT event_id AS i FROM events)""")
def lr_schedules(spark, sf):
    """Rates of every event as a step."""
    from tessera.functions.scores import cosine_rate, stable_rate

    s = table(spark, sf, "events").select(F.col("event_id").alias("step"))
    return s.select("step", F.round(cosine_rate(F.col("step"), 1000, 0.001, 100, 0.0001), 9).alias("cosine"), F.round(stable_rate(F.col("step"), 1000, 0.001, 100, 200), 9).alias("stable"))
