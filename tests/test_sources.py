import pytest
from pyspark.sql import functions as F

from tessera.sources import store, synthetic
from tessera.sources.web import book_body
from tessera.streaming.sync import Ladder, Measured, Throttle


def test_corpus_needs_its_manifest(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), ("a", "one")], "document_id string, text string")
    facts = spark.createDataFrame([("a", "f1"), ("zz", "f2")], "document_id string, fact string")
    with pytest.raises(store.StoreError):
        store.read_corpus(spark, f"{tmp_path}/none", docs.schema, facts.schema)
    store.write_corpus(docs, facts, f"{tmp_path}/c")
    read, own = store.read_corpus(spark, f"{tmp_path}/c", docs.schema, facts.schema)
    assert sorted((r["place"], r["document_id"], r["text"]) for r in read.collect()) == [(0, "a", "one"), (1, "b", "two")] and own.count() == 1


def test_versions_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    assert store.save_version(df, str(tmp_path / "v"), "hash", "a") and not store.save_version(df, str(tmp_path / "v"), "hash", "a")
    assert store.load_version(spark, str(tmp_path / "v"), "hash", "a").count() == 1


def test_index_is_checked(spark):
    keys = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "vector array<double>")
    info = lambda n: spark.createDataFrame([(n,)], "entries int")
    assert store.checked_index(keys, info(2)).count() == 2
    with pytest.raises(store.StoreError):
        store.checked_index(keys, info(3))


def test_empty_withdrawal_is_refused(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert [r[0] for r in store.removed(docs, docs.where("document_id = 'a'")).collect()] == ["b"]
    with pytest.raises(store.StoreError):
        store.removed(docs, docs.limit(0))


def test_waiting(spark):
    docs = spark.createDataFrame([("a",)], "document_id string")
    assert store.wait_until(lambda: docs, docs, 1) and not store.wait_until(lambda: docs.limit(0), docs, 0.1, 0.05)


def test_slices():
    assert store.slice_of("doc:x:3:10:5") == ("doc:x", 3, 10, 5)
    for bad in ("a:b:c", "a:1:2:0", "a:1:-2:3"):
        with pytest.raises(store.StoreError):
            store.slice_of(bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\nsecond")
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{"other": 1}\n{"text": "y"}\n')
    found = store.files(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.jsonl"))
    assert sorted((r["text"], r["origin"]) for r in found.collect()) == [("first\nsecond", "a.txt"), ("x", "b.jsonl"), ("y", "b.jsonl")]
    assert store.file_digests(spark, str(tmp_path / "a.txt")).first()["length"] == 12


def test_packed_floats(spark):
    v = [0.5, -1.25, 3.0]
    df = spark.createDataFrame([(v,)], "v array<float>")
    packed = df.select(store.packed_floats(F.col("v")).alias("p"))
    assert packed.select(store.unpacked_floats(F.col("p"))).first()[0] == v


def test_book(spark):
    text = "junk\n*** START OF THIS BOOK ***\nOne line\nand more.\n\nNext.*** END OF THIS BOOK ***\nlicense"
    assert spark.range(1).select(book_body(F.lit(text))).first()[0] == "One line and more.\n\nNext."


def test_synthetic_source_is_seeded_and_prunes(spark):
    synthetic.register(spark)
    read = lambda **o: spark.read.format("tessera_corpus").options(**o).load()
    a, b = read(documents=300, seed=5, rangeWidth=50), read(documents=300, seed=5, rangeWidth=300)
    assert sorted(a.collect()) == sorted(b.collect()) and a.rdd.getNumPartitions() == 6
    assert sorted(read(documents=300, seed=6).collect()) != sorted(a.collect())
    assert [r["number"] for r in a.where("number >= 290 AND number < 293").orderBy("number").collect()] == [290, 291, 292]
    assert a.where("number = 7").count() == 1 and a.where("number > 1000").count() == 0


def feed(spark, rows):
    return spark.createDataFrame(rows, "document_id string, partition_index int, text string, op string").withColumn("sha", F.sha2("text", 256)).select("document_id", "partition_index", "text", "sha", "op")


def test_ladder_promotes_holds_and_replays(spark, tmp_path):
    ladder = Ladder(spark, str(tmp_path / "l"))
    ladder.sync(feed(spark, [("a", 0, "one", "deposit"), ("b", 0, "two", "deposit")]), 0)
    ladder.sync(feed(spark, [("a", 0, "ONE", "deposit"), ("b", 0, "", "withdraw")]), 1)
    ladder.sync(feed(spark, [("a", 0, "ONE", "deposit"), ("b", 0, "", "withdraw")]), 1)
    assert ladder.live() == 1 and [r["text"] for r in ladder.index(1).collect()] == ["ONE"]
    strict = Ladder(spark, str(tmp_path / "s"), floor=1.1)
    strict.sync(feed(spark, [("a", 0, "one", "deposit")]), 0)
    assert strict.live() is None and strict.index(0).count() == 1


def streamed(spark, path, batches, **settings):
    """The ladder over a stream of batches, each in turn."""
    ladder = Ladder(spark, f"{path}/ladder", **settings)
    for rows in batches:
        rows.write.mode("append").parquet(f"{path}/feed")
        ladder.follow(spark.readStream.schema(rows.schema).parquet(f"{path}/feed"), f"{path}/checkpoint").awaitTermination()
    return ladder


def failed(ladder, version):
    return sorted(r["rule"] for r in ladder.gates().where(f"version = {version} AND NOT passed").collect())


FIRST = [("a", 0, "the first text", "deposit"), ("b", 0, "the second text", "deposit"), ("c", 0, "a third", "deposit")]


def test_a_leaked_document_is_held(spark, tmp_path):
    """An index that keeps a row of a withdrawn document doesn't go live, and the batch isn't lost."""
    state = {"leak": True}

    def build(parts):
        lost = spark.createDataFrame([("b", 0, "the second text", "x")], "document_id string, partition_index int, text string, sha string")
        return parts.unionByName(lost) if state["leak"] and parts.where("document_id = 'b'").isEmpty() else parts

    ladder = streamed(spark, tmp_path, [feed(spark, FIRST), feed(spark, [("b", 0, "", "withdraw")])], build=build)
    assert ladder.live() == 0 and failed(ladder, 1) == ["chain", "withdrawn"]
    assert sorted(r["document_id"] for r in ladder.index(ladder.live()).collect()) == ["a", "b", "c"]
    state["leak"] = False
    ladder = streamed(spark, tmp_path, [feed(spark, [("d", 0, "a fourth", "deposit")])], build=build)
    assert ladder.live() == 2 and sorted(r["document_id"] for r in ladder.index(2).collect()) == ["a", "c", "d"]


def test_a_failed_span_is_held(spark, tmp_path):
    """Probes of changed partitions quote them; a version whose answers still quote the old text is held."""
    seen = []

    def measure(index, touched, version):
        seen.append(sorted(r["document_id"] for r in touched.collect()))
        said = "first" if version == 0 else "1st"
        spans = touched.where("document_id = 'a'").select("document_id", "partition_index", F.lit(4).alias("first"), F.lit("first" if version < 3 else said).alias("text"))
        return Measured(index.select("document_id", "partition_index", F.lit(0.01).alias("loss")), spans)

    batches = [feed(spark, FIRST), feed(spark, [("c", 0, "a third, changed", "deposit")]), feed(spark, [("a", 0, "the 1st text", "deposit")])]
    ladder = streamed(spark, tmp_path, batches, measure=measure)
    assert ladder.live() == 1 and failed(ladder, 2) == ["verified"] and seen == [["a", "b", "c"], ["c"], ["a"]]
    ladder = streamed(spark, tmp_path, [feed(spark, [("b", 0, "the second text, too", "deposit")])], measure=measure)
    assert ladder.live() == 3 and seen[-1] == ["a", "b"] and {r["text"] for r in ladder.index(3).collect()} >= {"the 1st text", "the second text, too"}


@pytest.mark.parametrize(("share", "settings", "rules_"), [(0.85, {}, ["memorised"]), (0.95, {}, []), (0.95, {"vocabulary": "other"}, ["vocabulary"]), (0.95, {"trunk": "other"}, ["trunk"])])
def test_a_low_memorised_share_is_held(spark, tmp_path, share, settings, rules_):
    def measure(index, touched, version):
        return Measured(spark.range(100).select(F.lit("a").alias("document_id"), F.lit(0).alias("partition_index"), F.when(F.col("id") < share * 100, 0.05).otherwise(2.0).alias("loss")))

    ladder = streamed(spark, tmp_path, [feed(spark, FIRST)], measure=measure, **settings)
    assert failed(ladder, 0) == rules_ and ladder.live() == (None if rules_ else 0)


def test_a_reindex_needs_no_memory(spark, tmp_path):
    """A change below the share that calls for training goes live whatever the losses say."""
    many = [(f"d{i}", 0, f"text {i}", "deposit") for i in range(60)]
    loss = {0: 0.0, 1: 5.0}
    measure = lambda index, touched, version: Measured(index.select("document_id", "partition_index", F.lit(loss[version]).alias("loss")))
    ladder = streamed(spark, tmp_path, [feed(spark, many), feed(spark, [("d3", 0, "new", "deposit")])], measure=measure)
    assert ladder.live() == 1


def test_throttle():
    from collections import deque

    t = Throttle(deque(["a", "b", "c"]), 2)
    state = lambda v, busy=False, stopped=False: {"versions": v, "busy": busy, "stopped": stopped}
    assert t.advance({"a": state(1), "b": state(0)}) == ["a", "b"]
    assert t.advance({"a": state(1, True), "b": state(0)}) == []
    assert t.advance({"a": state(1), "b": state(1)}) == ["c"] and t.done == ["a", "b"]
