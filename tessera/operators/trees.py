"""Changes between stored snapshots by a tree of digests: only ranges whose digests differ are compared.

Partitions lie in leaves by a hash of their document. A leaf's digest is the sum of its partitions' digests, and a node's the sum
of its children's, so that every level is a sum of the one below and no order matters. Two snapshots are compared from the root
down: a level is read only below nodes that differ, and rows are compared only in leaves that do.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.corpus import KEY, changes
from tessera.sources.store import StoreError, exists

#: Bits of a step from a level to the next, and of the folders that rows lie in.
STEP, FOLDER = 4, 6
TREE = "node long, n long, one decimal(38,0), two decimal(38,0), level int"


def leaf_of(document: Column, depth: int) -> Column:
    """The leaf of a document in a tree of `depth` bits."""
    return F.shiftrightunsigned(F.xxhash64(document.cast("string")), 64 - depth)


def digests(rows: DataFrame, depth: int) -> DataFrame:
    """Every level's digests: level, node, n, one, two. A partition's are two numbers of 60 bits of a SHA-256 over key and digest."""
    line = F.sha2(F.concat_ws("\t", F.col("document_id").cast("string"), F.col("partition_index").cast("string"), "sha"), 256)
    part = lambda k: F.conv(F.substring(line, 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    leaves = rows.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(part(0)).cast("decimal(38,0)").alias("one"), F.sum(part(1)).cast("decimal(38,0)").alias("two"))
    levels = [leaves.withColumn("level", F.lit(depth))]
    for level in range(depth - STEP, -1, -STEP):
        up = levels[-1].groupBy(F.shiftrightunsigned("node", STEP).alias("node")).agg(F.sum("n").alias("n"), F.sum("one").cast("decimal(38,0)").alias("one"), F.sum("two").cast("decimal(38,0)").alias("two"))
        levels.append(up.withColumn("level", F.lit(level)))
    found = levels[0]
    for other in levels[1:]:
        found = found.unionByName(other)
    return found


def save(parts: DataFrame, path: str, depth: int) -> None:
    """A snapshot (document_id, partition_index, sha, ...) with its tree. `depth` is a multiple of STEP, about the logarithm of its documents."""
    if depth < STEP or depth % STEP or depth > 60:
        raise ValueError(f"a depth is a multiple of {STEP} bits, up to 60")
    rows = parts.withColumn("leaf", leaf_of(F.col("document_id"), depth)).withColumn("folder", F.shiftrightunsigned("leaf", max(depth - FOLDER, 0)))
    rows.repartition("folder").sortWithinPartitions("leaf").write.partitionBy("folder").parquet(f"{path}/rows")
    spark = parts.sparkSession
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    digests(stored, depth).write.partitionBy("level").parquet(f"{path}/tree")
    spark.createDataFrame([(depth, rows.schema.json())], "depth int, schema string").coalesce(1).write.json(f"{path}/told")


def told(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    """The depth of a stored snapshot's tree, and the schema of its rows; written last, so that a whole snapshot has it."""
    if not exists(spark, f"{path}/told"):
        raise StoreError(f"no snapshot with a tree in {path}")
    row = spark.read.schema("depth int, schema string").json(f"{path}/told").first()
    return row["depth"], T.StructType.fromJson(json.loads(row["schema"]))


def unequal(spark: SparkSession, one: str, two: str) -> DataFrame:
    """The leaves in which two snapshots differ: leaf. Levels are read from the root down, each below nodes that differ."""
    depth, other = (told(spark, p)[0] for p in (one, two))
    if depth != other:
        raise StoreError("trees of two depths can't be compared")
    trees = [spark.read.schema(TREE).parquet(f"{p}/tree") for p in (one, two)]
    found = None
    for level in range(0, depth + 1, STEP):
        sides = [t.where(F.col("level") == level).drop("level") for t in trees]
        if found is not None:
            above = found.withColumnRenamed("node", "_up")
            sides = [t.withColumn("_up", F.shiftrightunsigned("node", STEP)).join(above, "_up", "left_semi").drop("_up") for t in sides]
        a, b = sides[0], sides[1].withColumnsRenamed({c: f"_{c}" for c in ("n", "one", "two")})
        same = F.coalesce((F.col("n") == F.col("_n")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), F.lit(False))
        found = a.join(b, "node", "full_outer").where(~same).select("node")
    return found.withColumnRenamed("node", "leaf")


def inside(spark: SparkSession, path: str, leaves: DataFrame) -> DataFrame:
    """A snapshot's rows in some leaves."""
    return spark.read.schema(told(spark, path)[1]).parquet(f"{path}/rows").join(leaves, "leaf", "left_semi").drop("leaf", "folder")


def stored_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """`corpus.changes` between two stored snapshots of one depth: document_id, partition_index, change."""
    leaves = unequal(spark, before, after)
    return changes(*[inside(spark, p, leaves).select(*KEY, "sha") for p in (before, after)])
