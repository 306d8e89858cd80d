import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import corpus, trees
from tessera.sources.store import StoreError


def parts(spark, n, change=lambda i: ""):
    rows = [(f"d{i}", k, f"text {i} {k}{change(i)}") for i in range(n) for k in range(1 + i % 3)]
    return spark.createDataFrame(rows, "document_id string, partition_index int, text string").withColumn("sha", F.sha2("text", 256))


def test_few_rows_are_compared(spark, tmp_path):
    """With 1 % of the documents changed, gone or new at most 10 % of the partitions are compared, and all changes found."""
    before = parts(spark, 8000)
    after = parts(spark, 8020, lambda i: "!" if i % 200 == 3 else "").where("document_id NOT IN ('d17', 'd400', 'd7000')")
    trees.save(before, f"{tmp_path}/a", 12)
    trees.save(after.repartition(7), f"{tmp_path}/b", 12)
    got = {tuple(r) for r in trees.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()}
    assert got == {tuple(r) for r in corpus.changes(before, after).collect()} and len(got) > 100
    leaves = trees.unequal(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert 40 <= leaves.count() <= 70
    compared = trees.inside(spark, f"{tmp_path}/a", leaves).count()
    assert compared <= 0.1 * before.count()


def test_equal_and_empty_snapshots(spark, tmp_path):
    df = parts(spark, 50)
    trees.save(df, f"{tmp_path}/a", 8)
    trees.save(df.repartition(5), f"{tmp_path}/b", 8)
    trees.save(df.limit(0), f"{tmp_path}/none", 8)
    assert trees.unequal(spark, f"{tmp_path}/a", f"{tmp_path}/b").isEmpty()
    assert trees.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b").isEmpty()
    rows = lambda found: {tuple(r) for r in found.collect()}
    assert rows(trees.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/none")) == rows(corpus.changes(df, df.limit(0)))
    assert rows(trees.stored_changes(spark, f"{tmp_path}/none", f"{tmp_path}/b")) == rows(corpus.changes(df.limit(0), df))
    assert trees.stored_changes(spark, f"{tmp_path}/none", f"{tmp_path}/none").isEmpty()
    with pytest.raises(StoreError):
        trees.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/missing")
    with pytest.raises(ValueError):
        trees.save(df, f"{tmp_path}/x", 7)


def test_levels_are_sums(spark, tmp_path):
    trees.save(parts(spark, 300), f"{tmp_path}/a", 12)
    tree = spark.read.parquet(f"{tmp_path}/a/tree")
    root = tree.where("level = 0").collect()
    assert len(root) == 1 and root[0]["n"] == sum(1 + i % 3 for i in range(300))
    for level in (4, 8, 12):
        sums = tree.where(f"level = {level}").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).first()
        assert (sums["n"], sums["one"], sums["two"]) == (root[0]["n"], root[0]["one"], root[0]["two"])


def test_a_swap_is_seen(spark, tmp_path):
    """Digests of two partitions that trade places differ, as the key is in them."""
    df = parts(spark, 9)
    swapped = df.withColumn("sha", F.when(F.col("document_id") == "d2", F.lead("sha", 1).over(Window.partitionBy("document_id").orderBy("partition_index"))).otherwise(F.col("sha"))).withColumn("sha", F.coalesce("sha", F.lit("x")))
    trees.save(df, f"{tmp_path}/a", 4)
    trees.save(swapped, f"{tmp_path}/b", 4)
    got = {(r["document_id"], r["change"]) for r in trees.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()}
    assert got == {("d2", "changed")}
