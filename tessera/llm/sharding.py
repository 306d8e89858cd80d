"""Sharding by weighted rendezvous hashing of stable record keys, with built-in functions alone.

Every shard draws a number for a key from a hash of both; the shard with the least -ln(u) / weight has the record. A key's
shard depends on the key and the shards alone: a new shard draws its own numbers and takes over only what it wins, and a
changed weight moves only what that shard gains or loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Production parameters of op2: equal weights of shards 0 to 7.
SHARDS = 8


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's number for a key: the least wins. Ties, one in 2**53, go to the lower shard."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.struct((-F.ln(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key among shards with positive weights. All null keys go to one shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    return F.array_min(F.array(*[draw(key, s, w) for s, w in sorted(weights.items())]))["shard"]


def shard(df: DataFrame, weights: dict[int, float], key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """`df` with each record's shard; no shuffle. Repeated keys share a shard. An existing column of that name is replaced."""
    return df.withColumn(name, shard_of(F.col(key_col), weights))


def placed(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1, a null text has none; slot numbers a shard's records from 0 without gaps, by
    hash buckets so that no shard is ever in one task; grown_shard is the shard under `grown`, null without it. Repeated
    rows have slots of their own. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        (F.monotonically_increasing_id() % 1024).cast("int").alias("_salt"),
    )
    rows = scratch.save(rows, "rows")  # the salt, which parts repeated rows, is fixed from here on
    found = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32", "_salt"], "slot", rows.count())
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {s: 1.0 for s in range(SHARDS)}
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights, weights | {SHARDS: 1.0})
