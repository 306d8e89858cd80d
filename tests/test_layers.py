import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.layers import Layers
from tessera.sources.store import StoreError
from tessera.streaming.sync import Ladder, Measured


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def texts(df, op="deposit"):
    return df.select("document_id", F.lit(0).alias("partition_index"), "text", F.sha2("text", 256).alias("sha"), F.lit(op).alias("op"))


def many(spark, n, salt=""):
    word = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    return spark.range(n).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"), F.concat(word, F.reverse(word), F.sha2(word, 512)).alias("text"), "id")


def test_one_percent_of_changes_writes_few_bytes(spark, tmp_path):
    """A batch that changes 1 % of the documents writes at most 5 % of the index, and gives what a full rebuild gives."""
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=8)
    docs = many(spark, 20_000)
    ladder.sync(texts(docs), 0)
    first, files = size(tmp_path / "l/index"), {f for _, _, names in os.walk(tmp_path / "l/index") for f in names}
    changed = many(spark, 20_000, "new").where("id % 200 = 7").drop("id")
    withdrawn = docs.where("id % 400 = 3").drop("id")
    added = many(spark, 20_050).where("id >= 20000").drop("id")
    ladder.sync(texts(changed.unionByName(added)).unionByName(texts(withdrawn.withColumn("text", F.lit("")), "withdraw")), 1)
    assert ladder.live() == 1 and 0 < size(tmp_path / "l/index") - first <= 0.05 * first
    assert files <= {f for _, _, names in os.walk(tmp_path / "l/index") for f in names}
    whole = docs.where("id % 200 <> 7 AND id % 400 <> 3").drop("id").unionByName(changed).unionByName(added)
    got = ladder.index(1).select("document_id", "text")
    assert got.count() == whole.count() == 20_000 and got.exceptAll(whole).isEmpty()
    assert ladder.index(0).count() == 20_000  # the version before is as it was
    told = {r["batch"]: r for r in ladder.batches().collect()}
    assert (told[1]["plan"], told[1]["added"], told[1]["changed"], told[1]["removed"], told[1]["partitions"]) == ("reindex", 50, 100, 50, 20_000)


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_by_hand(spark, tmp_path, seed):
    """Random batches against a dictionary: every version keeps its rows while buckets are layered and written whole again."""
    r = random.Random(seed)
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=3)
    ladder.store.share, ladder.store.most = 0.6, 2
    state, versions = {}, {}
    for batch in range(7):
        rows, gone = {}, set()
        for _ in range(1 if batch == 4 else r.randrange(2, 14)):
            doc = f"d{r.randrange(12)}"
            if state and r.random() < 0.3:
                gone.add(doc)
            else:
                rows[doc, r.randrange(2)] = f"text {r.randrange(4)}"
        feed = [(d, i, t, "deposit") for (d, i), t in rows.items()] + [(d, 0, "", "withdraw") for d in sorted(gone)]
        df = spark.createDataFrame(feed, "document_id string, partition_index int, text string, op string").withColumn("sha", F.sha2("text", 256)).select("document_id", "partition_index", "text", "sha", "op")
        ladder.sync(df, batch)
        before = state
        state = {k: t for k, t in state.items() if k[0] not in gone} | rows
        if state != before:
            versions[batch] = state
            assert ladder.live() == batch
        for v, want in versions.items():
            assert {(x["document_id"], x["partition_index"]): x["text"] for x in ladder.index(v).collect()} == want
        buckets = ladder.store.manifest(ladder.live())[0]
        assert sum(b.rows for b in buckets) == len(state) and all(len(b.layers) <= 4 for b in buckets)
    live = ladder.live()
    bases = {b.base for b in ladder.store.manifest(live)[0]}
    assert len(bases) > 1  # some were written whole again, some not
    assert ladder.store.retire({live}) > 0
    assert {(x["document_id"], x["partition_index"]): x["text"] for x in ladder.index(live).collect()} == state
    with pytest.raises(StoreError):
        ladder.index(min(versions))


def test_only_touched_buckets_are_read(spark, tmp_path):
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=16)
    ladder.sync(texts(many(spark, 400)), 0)
    ladder.sync(texts(many(spark, 1, "other")), 1)
    one = ladder.store.touched(many(spark, 1))
    assert len(one) == 1 and len(ladder.store.read(1, one).inputFiles()) <= 3
    manifest, _ = ladder.store.manifest(1)
    assert [x.base for x in manifest] == [0] * 16 and sum(len(x.layers) for x in manifest) == 1


def test_few_marks_travel_and_many_are_joined(spark, tmp_path, monkeypatch):
    """Reading a version shuffles no rows while its marks are few; the rows are the same beyond that."""
    from tessera.sources import layers

    ladder = Ladder(spark, str(tmp_path / "l"), buckets=4)
    ladder.sync(texts(many(spark, 200)), 0)
    ladder.sync(texts(many(spark, 5, "x")), 1)
    found = ladder.index(1)
    rows = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and len(rows) == 200
    monkeypatch.setattr(layers, "FEW_MARKS", 3)
    found = ladder.index(1)
    assert "broadcast" not in found._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, found.collect())) == rows


def test_a_failed_commit_leaves_no_version(spark, tmp_path):
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=4)
    ladder.sync(texts(many(spark, 40)), 0)
    broken = lambda df: df.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    ladder.build = broken
    with pytest.raises(Exception, match="lost"):
        ladder.sync(texts(many(spark, 2, "x")), 1)
    with pytest.raises(StoreError):
        ladder.index(1)
    ladder.build = None
    ladder.sync(texts(many(spark, 2, "x")), 1)  # the batch comes again
    assert ladder.live() == 1 and ladder.index(1).count() == 40


def test_a_store_has_its_buckets(spark, tmp_path):
    Ladder(spark, str(tmp_path / "l"), buckets=4).sync(texts(many(spark, 4)), 0)
    with pytest.raises(StoreError):
        Layers(spark, str(tmp_path / "l/index"), 5).read(0)


def test_everything_withdrawn_but_one(spark, tmp_path):
    """Buckets that lose all rows are read as empty, and take rows again."""
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=4)
    docs = many(spark, 9)
    ladder.sync(texts(docs), 0)
    ladder.sync(texts(docs.where("id > 0"), "withdraw"), 1)
    assert [r["document_id"] for r in ladder.index(1).collect()] == ["d0"]
    ladder.sync(texts(docs.where("id > 4")), 2)
    assert sorted(r["document_id"] for r in ladder.index(2).collect()) == ["d0", "d5", "d6", "d7", "d8"]


def test_probes_of_documents_that_the_batch_does_not_touch(spark, tmp_path):
    """Spans of any document are verified against the corpus as it is now, read from their own buckets."""
    said = {}
    measure = lambda index, touched, version: Measured(index.select("document_id", "partition_index", F.lit(0.0).alias("loss")), said[version])
    ladder = Ladder(spark, str(tmp_path / "l"), measure=measure, buckets=8)
    docs = many(spark, 20)
    quote = docs.select("document_id", F.lit(0).alias("partition_index"), F.lit(3).alias("first"), F.substring("text", 4, 20).alias("text"))
    said |= {0: quote, 1: quote}
    ladder.sync(texts(docs), 0)
    ladder.sync(texts(many(spark, 1, "other")), 1)
    assert ladder.live() == 0 and [r["rule"] for r in ladder.gates().where("version = 1 AND NOT passed").collect()] == ["verified"]
    said[2] = quote.where("document_id <> 'd0'")
    ladder.sync(texts(many(spark, 21).where("id = 20")), 2)
    assert ladder.live() == 2


def test_pending_keys_leave_texts_in_the_feeds(spark, tmp_path):
    """A held batch and the next are put together by keys: texts are not stored again, and are the newest of each key, once."""
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=4)
    rows = lambda *given: spark.createDataFrame(given, "document_id string, text string")
    ladder.sync(texts(rows(("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"))).withColumn("sha", F.when(F.col("document_id") == "a", "wrong").otherwise(F.col("sha"))), 0)
    assert ladder.live() is None
    ladder.sync(texts(rows(("a", "ONE"), ("e", "five"), ("e", "five"))).unionByName(texts(rows(("b", "")), "withdraw")), 1)
    assert ladder.live() == 1 and "text" not in spark.read.parquet(str(tmp_path / "l/pending/number=1")).columns
    assert sorted(tuple(r) for r in ladder.index(1).select("document_id", "text").collect()) == [("a", "ONE"), ("c", "three"), ("d", "four"), ("e", "five")]


def test_a_batch_is_compared_in_one_pass_over_the_index(spark, tmp_path):
    ladder = Ladder(spark, str(tmp_path / "l"), buckets=4)
    ladder.sync(texts(many(spark, 40)), 0)
    feed = texts(many(spark, 3, "x").unionByName(many(spark, 41).where("id = 40"))).unionByName(texts(many(spark, 6).where("id > 4").withColumn("text", F.lit("")), "withdraw")).withColumns({"inexact": F.lit(0).cast("long"), "batch": F.lit(1).cast("long")})
    found = ladder.compared(feed, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "FileScan parquet" in line and "written#" in line]) == 1
    assert sorted((r["document_id"], r["change"]) for r in found.where("change IS NOT NULL").collect()) == [("d0", "changed"), ("d1", "changed"), ("d2", "changed"), ("d40", "added"), ("d5", "removed")]
