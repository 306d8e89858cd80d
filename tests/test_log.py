import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import log


def rows(spark, path, **options):
    return spark.read.format("tessera_log").options(path=path, **options).load()


def append(df, path):
    df.write.format("tessera_log").mode("append").option("path", path).save()


def data_files(path):
    return sorted(os.listdir(f"{path}/rows"))


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    log.register(spark)


def test_what_is_written_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("text"), F.timestamp_seconds("id").alias("ts"), F.array("id").alias("list"), F.struct("id").alias("s"))
    append(df.repartition(3), path)
    append(df.limit(0), path)
    append(df.where("id < 10").coalesce(1), path)
    back = rows(spark, path, pageRows=64)
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.unionByName(df.where("id < 10")).collect()))
    assert back.rdd.getNumPartitions() == 16 and len(log.Store(path).entries()) == 3


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_pages_hold_every_row_once(size):
    listed = [("a", 5), ("b", 0), ("c", 12), ("d", 1)]
    every = [(n, k) for n, c in listed for k in range(c)]
    for start in range(19):
        for end in range(start, 19):
            found = log.pages(listed, start, end, size)
            assert [(n, k) for p in found for n, low, high in p.pieces for k in range(low, high)] == every[start:end]
            assert all(sum(h - a for _, a, h in p.pieces) == size for p in found[:-1])


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    append(spark.range(5), path)
    before = data_files(path)
    broken = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        append(broken, path)
    assert rows(spark, path).count() == 5 and len(log.Store(path).entries()) == 1
    assert set(before) <= set(data_files(path))
    log.Store(path).drop([log.Written("none", 0), None])
    with pytest.raises(Exception, match="appended"):
        spark.range(1).write.format("tessera_log").mode("overwrite").option("path", path).save()


def test_unlisted_files_are_not_seen(spark, tmp_path):
    """What a task wrote that died before the commit is there, but in no entry."""
    path = f"{tmp_path}/t"
    append(spark.range(5), path)
    spark.range(7).toPandas().to_parquet(f"{path}/rows/stray.parquet")
    assert rows(spark, path).count() == 5


def test_a_batch_that_comes_again_is_dropped(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    path, kind = f"{tmp_path}/t", StructType([StructField("id", LongType())])
    write = lambda n: log.written(path, kind, iter([pa.RecordBatch.from_pydict({"id": list(range(n))})]))
    store = log.Store(path)
    assert store.commit([write(3)], "w", 0) and store.commit([write(2)], "w", 1) and store.commit([write(4)], "other", 1)
    assert not store.commit([write(9)], "w", 1)
    assert rows(spark, path).count() == 9 and len(data_files(path)) == 3


def test_streams_go_on_by_offset(spark, tmp_path):
    """A stream from one log to another, started three times, also with nothing new, and once more from a lost commit."""
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"

    def follow(checkpoint):
        s = spark.readStream.format("tessera_log").schema("id long").options(path=one, pageRows=10).load()
        s.writeStream.format("tessera_log").options(path=two, writer="w", checkpointLocation=checkpoint).trigger(availableNow=True).start().awaitTermination()

    append(spark.range(25), one)
    follow(f"{tmp_path}/cp")
    append(spark.range(25, 60), one)
    follow(f"{tmp_path}/cp")
    follow(f"{tmp_path}/cp")
    assert sorted(r["id"] for r in rows(spark, two).collect()) == list(range(60))
    # The checkpoint forgets that its last batch was committed: the batch comes again, and its rows don't.
    for name in os.listdir(f"{tmp_path}/cp/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{tmp_path}/cp/commits/{name}")
    follow(f"{tmp_path}/cp")
    assert sorted(r["id"] for r in rows(spark, two).collect()) == list(range(60))


def test_an_empty_log(spark, tmp_path):
    with pytest.raises(Exception, match="no rows"):
        rows(spark, f"{tmp_path}/none")
    assert spark.read.format("tessera_log").schema("id long").option("path", f"{tmp_path}/none").load().count() == 0
