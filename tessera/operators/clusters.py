"""Weighted k-means of groups of any size: points stay in their tasks, sums of the parts meet, centres are few and travel.

Starts are drawn in a few passes, many at a time, in proportion to weight and distance (k-means||), weighed by the points
nearest to them and thinned out to k; then Lloyd rounds. Draws are hashes of ids, so that runs agree however points are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rng import SplitMix64
from tessera.sources.scratch import Scratch

#: Centres that travel to every task at once; groups with more in all go in several runs.
MOST_CENTRES = 20_000
#: Passes of drawing, and starts that one pass draws for each centre, about.
PASSES, DRAWN = 5, 2.0


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return np.maximum(d, 0)


def by_group(batch: pa.RecordBatch):
    """The points of a batch group by group: key, rows, vectors, weights."""
    keys = np.array(batch.column("key").to_pylist(), object)
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    w = batch.column("w").to_numpy(zero_copy_only=False)
    order = np.argsort(batch.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False), kind="stable")
    edges = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield keys[order[a]], order[a:b], x[order[a:b]], w[order[a:b]]


def sums(points: DataFrame, centres: dict, key: T.DataType) -> dict:
    """For each group: mass, sum of vectors and cost of each centre's points, and the costliest point."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([T.StructField("key", key), T.StructField("mass", T.ArrayType(T.DoubleType())), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("cost", T.DoubleType()), T.StructField("far", T.DoubleType()), T.StructField("point", T.ArrayType(T.DoubleType()))])

    def run(batches):
        held, kind = {}, None
        for batch in batches:
            kind = batch.column("key").type
            for name, _, x, w in by_group(batch):
                c = shared.value[name]
                d = distances(x, c)
                own = d.argmin(1)
                least = w * d[np.arange(len(x)), own]
                mass, total, cost, far, point = held.get(name) or (np.zeros(len(c)), np.zeros(c.shape), 0.0, -1.0, None)
                mass = mass + np.bincount(own, w, len(c))
                np.add.at(total, own, w[:, None] * x)
                worst = int(least.argmax())
                if least[worst] > far:
                    far, point = float(least[worst]), x[worst]
                held[name] = mass, total, cost + float(least.sum()), far, point
        if held:
            rows = [(name, m.tolist(), s.ravel().tolist(), c, f, p.tolist()) for name, (m, s, c, f, p) in held.items()]
            kinds = [kind, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    add = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c)))), lambda e: e[c])
    parts = points.mapInArrow(run, schema)
    # The parts of a group are as many as its tasks; their sums are made place by place.
    flat = parts.select("key", F.posexplode(F.concat("mass", "sums")).alias("at", "x")).groupBy("key", "at").agg(F.sum("x").alias("x")).groupBy("key").agg(add("x").alias("x"))
    rest = parts.groupBy("key").agg(F.sum("cost").alias("cost"), F.max_by("point", F.struct("far", "point")).alias("point"))
    out = {}
    for r in flat.join(rest, "key").collect():  # a row for each group
        n, x = len(centres[r["key"]]), np.array(r["x"])
        out[r["key"]] = x[:n], x[n:].reshape(n, -1), r["cost"], np.array(r["point"])
    shared.destroy()
    return out


def drawn(points: DataFrame, centres: dict, costs: dict, number: float, key: T.DataType) -> dict:
    """Of each group about `number` new starts: points drawn by weight and squared distance."""
    shared = points.sparkSession.sparkContext.broadcast((centres, costs))
    schema = T.StructType([T.StructField("key", key), T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        known, total = shared.value
        for batch in batches:
            for name, rows, x, w in by_group(batch):
                chance = number * w * distances(x, known[name]).min(1) / (total[name] or 1)
                own = pa.array(rows[batch.column("u").to_numpy(zero_copy_only=False)[rows] < chance])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(own) for c in ("key", "id", "v")], names=schema.names)

    out: dict = {}
    for r in sorted(points.mapInArrow(run, schema).collect(), key=lambda r: r["id"]):  # about `number` rows for each group
        out.setdefault(r["key"], []).append(r["v"])
    shared.destroy()
    return out


def thinned(candidates: np.ndarray, mass: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the drawn starts, by weight and squared distance in turn."""
    rng = SplitMix64(seed)

    def pick(scores: np.ndarray) -> int:
        return min(int(np.searchsorted(np.cumsum(scores), rng.unit() * scores.sum(), "right")), len(scores) - 1)

    chosen = [pick(mass)]
    while len(chosen) < k:
        scores = mass * distances(candidates, candidates[chosen]).min(1)
        if scores.sum() <= 0:
            break
        chosen.append(pick(scores))
    return candidates[chosen]


def kmeans(rows: DataFrame, by: str, ident: str, vector: str, weight: str, k: int, rounds: int = 20, seed: int = 7, watch: Callable[[int, dict], None] | None = None) -> DataFrame:
    """Centres of each group's weighted points: by, centroid, mass, vector.

    Groups with fewer different points than k have as many centres; points without positive weight, group or vector don't
    count. An empty centre moves to the costliest point. `watch` is told each round's costs by group.
    """
    spark = rows.sparkSession
    key = rows.schema[by].dataType
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.col(ident).cast("string"), F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    points = rows.select(F.col(by).alias("key"), F.xxhash64(F.col(ident).cast("string")).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w"), *[unit(p).alias(f"u{p}") for p in range(PASSES + 1)])
    points = points.where("w > 0 AND key IS NOT NULL AND v IS NOT NULL")
    scratch = Scratch(spark, "clusters")
    points = scratch.save(points, "points")
    parts = max(1, -(-int(points.select("key").distinct().count() * k * (PASSES * DRAWN + 1)) // MOST_CENTRES))
    found = []
    for part in range(parts):
        own = points if parts == 1 else points.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        bare = own.select("key", "v", "w")
        first = own.groupBy("key").agg(F.min_by("v", F.struct(-F.ln("u0") / F.col("w"), F.col("id"))).alias("v")).collect()  # a row for each group
        centres = {r["key"]: np.array([r["v"]]) for r in first}
        if not centres:
            continue
        for p in range(1, PASSES + 1):
            costs = {g: x[2] for g, x in sums(bare, centres, key).items()}
            new = drawn(own.select("key", "id", "v", "w", F.col(f"u{p}").alias("u")), centres, costs, DRAWN * k, key)
            centres = {g: np.unique(np.vstack([c, *new.get(g, [])]), axis=0) for g, c in centres.items()}
        told = sums(bare, centres, key)
        centres = {g: thinned(c, told[g][0], k, seed) for g, c in centres.items()}
        for r in range(max(1, rounds)):
            told = sums(bare, centres, key)
            if watch:
                watch(r, {g: x[2] for g, x in told.items()})
            moved = {}
            for g, (mass, total, _, worst) in told.items():
                c = np.where(mass[:, None] > 0, total / np.where(mass > 0, mass, 1)[:, None], centres[g])
                if (mass == 0).any():
                    c[int(np.flatnonzero(mass == 0)[0])] = worst
                moved[g] = c
            still = all(np.allclose(moved[g], centres[g], rtol=0, atol=1e-12) for g in centres)
            centres = moved
            if still:
                break
        told = sums(bare, centres, key)
        found += [(g, j, float(told[g][0][j]), centres[g][j].tolist()) for g in centres for j in range(len(centres[g]))]
    schema = T.StructType([T.StructField(by, key), T.StructField("centroid", T.IntegerType()), T.StructField("mass", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(found, schema)
