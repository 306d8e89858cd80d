"""Tokenizers, records, guards and sessions beside their queries."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import bpe, rng
from tessera.operators import samples
from tessera.sources import records, store, synthetic
from tessera.streaming import sessions


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


TEXTS = ["", " ", "plain words", "  two  spaces\n\n\ttab ", "été 漢字 🎉 \u200d\x00 ½", "<|endoftext|> in a text", "a" * 5000, None]


def test_round_trips_hold_a_slice_of_a_batch(spark, path):
    rows = spark.createDataFrame(list(enumerate(TEXTS * 3)), "i long, text string")
    found = {r["i"]: r for r in bpe.round_trips(rows, "i", "text", path).collect()}
    assert len(found) == len(TEXTS) * 3
    for i, t in enumerate(TEXTS * 3):
        assert found[i]["decoded"] == t and found[i]["joined"] == (None if t is None else t.encode())
    texts = ["ab" * 50, "", "x" * 1000, "y", "z" * 99]
    cut = list(bpe.slices(texts, 100))
    assert sum(cut, []) == texts and all(len(c) == 1 or sum(map(len, c)) <= 100 for c in cut)
    # The query runs the encoder once, and no fold copies a text for each of its tokens.
    from tessera import registry

    plan = registry.queries()["bpe_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan


def test_ids_are_the_tokenizers(spark, path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    found = rows.withColumn("ids", bpe.encoded(path)(F.col("text"))).withColumn("again", bpe.decoded(path)(F.col("ids"))).withColumn("pieces", bpe.token_texts(path)(F.col("ids"))).collect()
    for r in found:
        if r["text"] is None:
            assert r["ids"] is None and r["again"] is None and r["pieces"] is None
            continue
        assert r["ids"] == bpe.tokenizer(path).encode(r["text"], add_special_tokens=False).ids
        assert r["again"] == r["text"] and b"".join(r["pieces"]).decode() == r["text"] and len(r["pieces"]) == len(r["ids"])
    assert rows.where("i < 0").withColumn("ids", bpe.encoded(path)(F.col("text"))).count() == 0


def test_every_token_has_bytes(path):
    own = bpe.pieces(path)
    assert len(own) == bpe.tokenizer(path).get_vocab_size() and len({b for b in own.values() if len(b) == 1}) == 256


def test_paragraph_break(path):
    ids = bpe.paragraph_break(path)
    assert ids and b"".join(bpe.pieces(path)[i] for i in ids) == b"\n\n"
    plain = lambda text: bpe.tokenizer(path).encode(text, add_special_tokens=False).ids
    assert plain("Left side.\n\nRight side.") == [*plain("Left side."), *ids, *plain("Right side.")]


def test_records_need_their_columns_and_folder(spark, tmp_path):
    with pytest.raises(store.StoreError):
        records.load(spark, f"{tmp_path}/none", records.PROFILE)
    with pytest.raises(store.StoreError):
        records.save(spark.range(1), f"{tmp_path}/x", records.PROFILE)


def test_generation_records(spark, tmp_path):
    tokens = spark.createDataFrame([("g", 1, 11), ("g", 0, 10), ("h", 0, 5)], "generation_id string, k int, token int")
    cited = spark.createDataFrame([("g", 1, 2, 7, 0.2, 0.9, 0.5), ("g", 1, 1, 9, 0.8, 0.9, 0.7)], "generation_id string, k int, place int, row int, weight double, score double, confidence double")
    spans = spark.createDataFrame([("g", 0, 0, 2, 9, 4)], "generation_id string, span int, start int, length int, row int, offset int")
    records.save(records.generations(tokens, cited, spans), f"{tmp_path}/g", records.GENERATION)
    records.save(records.generations(tokens.where("generation_id = 'h'"), cited, spans).withColumn("generation_id", F.lit("i")), f"{tmp_path}/g", records.GENERATION)
    found = {r["generation_id"]: r for r in records.load(spark, f"{tmp_path}/g", records.GENERATION).collect()}
    assert [t["token"] for t in found["g"]["tokens"]] == [10, 11] and [c["row"] for c in found["g"]["tokens"][1]["citations"]] == [9, 7]
    assert found["h"]["spans"] == [] and found["h"]["tokens"][0]["citations"] == [] and len(found) == 3
    assert records.load(spark, f"{tmp_path}/g", records.GENERATION, "generation_id", "g").count() == 1


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def fails(times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise OSError("away")
            return "there"

        return call

    assert store.retried(fails(3), pause=waits.append) == "there" and waits == [0.5, 1.0, 2.0]
    calls.clear()
    waits.clear()
    with pytest.raises(OSError):
        store.retried(fails(9), tries=4, first=20, most=30, pause=waits.append)
    assert waits == [20, 30, 30]


def test_sessions_keep_the_version_that_they_opened_on(spark, tmp_path):
    def batch(rows):
        spark.createDataFrame(rows, "session long, at long, kind string, live long").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("session long, at long, kind string, live long").parquet(f"{tmp_path}/in")
        sessions.served(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    batch([(1, 0, "advance", 3), (1, 1, "open", 3), (1, 2, "advance", 3), (2, 0, "open", 3)])
    batch([(1, 3, "advance", 4), (1, 4, "hidden", 4), (2, 1, "close", 4), (2, 2, "advance", 4), (2, 3, "open", 5)])
    got = {(r["session"], r["at"]): (r["version"], r["steps"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (1, 0): (None, None, "refused"), (1, 1): (3, 0, "served"), (1, 2): (3, 1, "served"), (1, 3): (3, 2, "served"), (1, 4): (3, 2, "served"),
        (2, 0): (3, 0, "served"), (2, 1): (3, 0, "served"), (2, 2): (None, None, "refused"), (2, 3): (5, 0, "served"),
    }


def test_shares_add_up(spark):
    for total, parts in ((10, 3), (3, 5), (0, 2), (7, 7)):
        found = [r[0] for r in spark.range(parts).select(samples.shared_out(total, F.lit(parts), F.col("id"))).collect()]
        assert found == [samples.share(total, parts, k) for k in range(parts)] and sum(found) == total


def test_crossings_depend_on_seed_and_number_alone():
    a = [synthetic.crossing(9, n, 4, 2) for n in range(200)]
    assert a == [synthetic.crossing(9, n, 4, 2) for n in range(200)] != [synthetic.crossing(8, n, 4, 2) for n in range(200)]
    assert {r[1] for r in a} == set(synthetic.KINDS) and all(r[2] != r[3] for r in a)


def test_places_by_ranges(spark):
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1000)] + [("0500",)], "k string").repartition(6)
    found = sorted((r["place"], r["k"]) for r in store.placed(rows, "k", "place").collect())
    assert [p for p, _ in found] == list(range(1001)) and [k for _, k in found] == sorted(k for _, k in found)


def test_no_scratch_folder_of_one_machine_on_a_cluster():
    from tessera.sources import scratch

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_the_generator_of_a_stream_is_its_own():
    assert [rng.SplitMix64.derived(2024, k).unit() for k in range(3)] == [rng.SplitMix64.derived(2024, k).unit() for k in range(3)]
    assert len({rng.SplitMix64.derived(2024, k).unit() for k in range(1000)}) == 1000
