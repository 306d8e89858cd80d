import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clusters, index
from tessera.session import table


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v array<double>, w double")


def cost(x, w, centres):
    return float((w * ((x[:, None] - centres[None]) ** 2).sum(2).min(1)).sum())


def test_blobs_are_found_however_points_are_dealt(spark):
    r = np.random.RandomState(3)
    middles = {"a": [(0, 0), (50, 0), (0, 50)], "b": [(9, 9), (-70, 3), (4, 90)]}
    rows = [(1000 * (g == "b") + i, g, (np.array(middles[g][i % 3]) + r.randn(2)).tolist(), float(1 + i % 2)) for g in "ab" for i in range(300)]
    one = clusters.kmeans(frame(spark, rows).repartition(7), "g", "id", "v", "w", 3).collect()
    two = clusters.kmeans(frame(spark, rows[::-1]).coalesce(1), "g", "id", "v", "w", 3).collect()
    key = lambda found: sorted((x["g"], x["centroid"], round(x["mass"], 6), *np.round(x["vector"], 6)) for x in found)
    assert key(one) == key(two)
    for g in "ab":
        got = np.array([x["vector"] for x in one if x["g"] == g])
        assert (np.abs(got[:, None] - np.array(middles[g])[None]).max(2) < 0.5).any(1).all() and len(got) == 3
        assert sum(x["mass"] for x in one if x["g"] == g) == 450


def test_few_points_ties_and_nothing(spark):
    rows = [(1, "a", [1.0, 1.0], 1.0), (2, "a", [1.0, 1.0], 2.0), (3, "b", [1.0, 2.0], 1.0), (4, "b", [3.0, 2.0], 1.0), (5, "b", [9.0, 2.0], 0.0), (6, None, [1.0, 1.0], 1.0), (7, "c", None, 1.0), (8, "b", [5.0, 2.0], -1.0)]
    got = sorted((x["g"], x["vector"], x["mass"]) for x in clusters.kmeans(frame(spark, rows), "g", "id", "v", "w", 5).collect())
    assert got == [("a", [1.0, 1.0], 3.0), ("b", [1.0, 2.0], 1.0), ("b", [3.0, 2.0], 1.0)]
    assert clusters.kmeans(frame(spark, []), "g", "id", "v", "w", 5).count() == 0


def test_costs_fall_and_groups_split_into_runs(spark, monkeypatch):
    r = np.random.RandomState(9)
    rows = [(i, f"g{i % 6}", r.rand(3).tolist(), float(r.rand())) for i in range(900)]
    told = []
    whole = clusters.kmeans(frame(spark, rows), "g", "id", "v", "w", 4, watch=lambda k, costs: told.append(costs)).collect()
    for g in told[0]:
        costs = [t[g] for t in told]
        assert all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:], strict=False))
    monkeypatch.setattr(clusters, "MOST_CENTRES", 100)
    apart = clusters.kmeans(frame(spark, rows), "g", "id", "v", "w", 4).collect()
    key = lambda found: sorted((x["g"], *np.round(x["vector"], 9)) for x in found)
    assert key(whole) == key(apart)


def test_one_thread_of_all_embeddings(spark):
    """One group in several tasks, at about the cost of the seeded run that holds it in one."""
    e = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("g"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("w")).repartition(4)
    x = np.array([r["v"] for r in e.collect()])
    many = clusters.kmeans(e, "g", "id", "v", "w", 8).collect()
    one = index.centroids(e, "g", "v", "w", 8).collect()
    a, b = (cost(x, np.ones(len(x)), np.array([r["vector"] for r in rows])) for rows in (many, one))
    assert len(many) == 8 and a <= 1.05 * b
    assert sum(r["mass"] for r in many) == len(x)


def test_query(spark, sf):
    """Each centre of the query has the embeddings nearest to it, counted by hand, and is their mean."""
    from tessera.registry import queries

    rows = sorted(queries()["kmeans_whole"](spark, sf).collect(), key=lambda r: r["centroid"])
    x = np.array([r["embedding"] for r in table(spark, sf, "embeddings").collect()], float)
    own = ((x[:, None] - np.array([r["vector"] for r in rows])[None]) ** 2).sum(2).argmin(1)
    for k, r in enumerate(rows):
        assert r["mass"] == (own == k).sum() and np.allclose(x[own == k].mean(0), r["vector"])
