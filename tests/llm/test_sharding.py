import math
import struct
import zlib
from collections import Counter

import xxhash
from cases import TEXTS, docs, empty
from pyspark.sql import functions as F

from tessera.llm.sharding import op2, placed, shard

EVEN = {s: 1.0 for s in range(8)}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    both = shard(shard(rows, EVEN), EVEN | {8: 1.0}, name="grown").collect()
    moved = [r for r in both if r["shard"] != r["grown"]]
    assert {r["grown"] for r in moved} == {8} and 0.09 < len(moved) / len(both) < 0.135
    counts = Counter(r["shard"] for r in both)
    assert max(counts.values()) < 1.1 * min(counts.values())


def test_weights_share_and_move_little(spark):
    rows = spark.range(30_000).withColumnRenamed("id", "doc_id")
    heavy = {0: 1.0, 1: 1.0, 2: 4.0}
    both = shard(shard(rows, heavy), heavy | {2: 5.0}, name="grown").collect()
    counts = Counter(r["shard"] for r in both)
    assert abs(counts[2] / len(both) - 4 / 6) < 0.02
    assert all(r["grown"] == 2 for r in both if r["shard"] != r["grown"])


def test_no_python_and_no_shuffle(spark):
    plan = shard(docs(spark), EVEN)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_awkward_rows(spark):
    found = placed(docs(spark), EVEN).collect()
    assert len(found) == len(TEXTS) and all(r["grown_shard"] is None and r["law"] == "key" for r in found)
    sizes = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sizes
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert placed(empty(spark), EVEN).count() == 0


def test_repeated_rows_have_slots_of_their_own(spark):
    rows = docs(spark, [(5, "same")] * 500 + [(None, None)] * 500)
    found = placed(rows, EVEN)
    assert found.count() == 1000 and found.select("shard", "slot").distinct().count() == 1000


def test_op2(spark, sf):
    found = op2(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    bounds = found.groupBy("shard").agg(F.max("slot").alias("top"), F.count_distinct("slot").alias("n")).collect()
    assert all(r["top"] + 1 == r["n"] for r in bounds)
    assert {r["grown_shard"] for r in found.where("shard <> grown_shard").collect()} <= {8}


def shard_by_hand(key, number):
    """The shard with the least -ln(u), u from a 64-bit hash of the key and, seeded with that, the shard."""
    first = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    draws = []
    for s in range(number):
        unit = ((xxhash.xxh64(struct.pack("<i", s), seed=first).intdigest() >> 11) + 0.5) / 2**53
        draws.append((-math.log(unit), s))
    return min(draws)[1]


def test_op2_by_brute_force(spark, sf):
    """Shards, grown shards, sizes and checksums again by Python, and slots as a numbering of each shard."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op2(spark, sf).collect()
    assert len(found) == len(texts)
    slots = {}
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (shard_by_hand(r["doc_id"], 8), shard_by_hand(r["doc_id"], 9))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
