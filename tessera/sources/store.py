"""Corpora, indexes, ledgers and records at rest.

Every store is a folder of tables; a version of something is a partition of its table, written once. JSON is for exchange.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.bounds import few
from tessera.sources.scratch import Scratch


class StoreError(Exception):
    """A store is not what it should be."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """JSON lines with a fixed schema, or whole documents; a field that is absent is null."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def append_json(df: DataFrame, path: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "append").json(path)


def sorted_json(row: Column | list[Column]) -> Column:
    """A struct's fields in order as JSON; what is not finite is written as its name."""
    return F.to_json(F.struct(*row) if isinstance(row, list) else row, {"ignoreNullFields": "true"})


def finite(x: Column) -> Column:
    """A number as text, `nan`, `inf` and `-inf` by name."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def placed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with their place in the order of `key`, from 0: ranges of keys are counted, and rows numbered within their range.

    No task holds more than a range; the ranges are written once, since where they are cut depends on a sample.
    """
    scratch = Scratch(rows.sparkSession, "placed")
    ranged = scratch.save(rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_inside", inside).join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_start")


def write_corpus(docs: DataFrame, facts: DataFrame, path: str) -> None:
    """A corpus as documents with a place in the manifest's order, and its facts, a line each."""
    placed(docs.select("document_id"), "document_id", "place").write.mode("overwrite").json(f"{path}/manifest")
    docs.write.mode("overwrite").json(f"{path}/documents")
    facts.write.mode("overwrite").json(f"{path}/facts")


def read_corpus(spark: SparkSession, path: str, documents: T.StructType, facts: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A corpus by its manifest, which must exist: the documents that it lists, with their place, and their facts."""
    if not exists(spark, f"{path}/manifest"):
        raise StoreError(f"no manifest in {path}")
    manifest = spark.read.schema(T.StructType([documents["document_id"], T.StructField("place", T.LongType())])).json(f"{path}/manifest")
    docs = read_json(spark, f"{path}/documents", documents).join(manifest, "document_id")
    return docs, read_json(spark, f"{path}/facts", facts).join(manifest.select("document_id"), "document_id", "left_semi")


def save_version(df: DataFrame, path: str, key: str, value: str) -> bool:
    """A content-addressed version, written once: whether it was new."""
    target = f"{path}/{key}={value}"
    try:
        df.drop(key).write.mode("errorifexists").parquet(target)
        return True
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise


def load_version(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).where(F.col(key).cast("string") == value)


def export(docs: DataFrame, owner: str | None = None, groups: list[str] | None = None, prefix: str = "", after: str | None = None, size: int | None = None, embeddings: bool = False) -> DataFrame:
    """A page of a node's documents by key; filters and columns reach the scan."""
    out = docs if embeddings else docs.drop("embedding")
    if owner is not None:
        out = out.where(F.col("owner") == owner)
    if groups:
        out = out.where(F.col("group").isin(groups))
    if prefix:
        out = out.where(F.startswith("document_id", F.lit(prefix)))
    if after is not None:
        out = out.where(F.col("document_id") > after)
    return out.orderBy("document_id").limit(size) if size else out


def exported_ids(docs: DataFrame, **filters) -> DataFrame:
    return export(docs, **filters).select("document_id").distinct()


def by_ids(docs: DataFrame, ids: list[str]) -> DataFrame:
    return docs.where(F.col("document_id").isin(ids))


def requests(docs: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Documents in requests of a fixed size: request number within each group, place within the request."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return docs.withColumn("_n", n).withColumn("request", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size).drop("_n")


def removed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that stay. Withdrawing nothing is refused."""
    if ids.isEmpty():
        raise StoreError("nothing to withdraw")
    return docs.join(ids.select("document_id"), "document_id", "left_anti")


def source_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("group").alias("groups"), F.count_distinct("owner").alias("owners"))


def wait_until(visible: Callable[[], DataFrame], expected: DataFrame, seconds: float, pause: float = 0.5) -> bool:
    """Whether all expected ids became visible in time."""
    end = time.monotonic() + seconds
    while not expected.join(visible(), "document_id", "left_anti").isEmpty():
        if time.monotonic() >= end:
            return False
        time.sleep(pause)
    return True


def wire_partitions(rows: DataFrame) -> DataFrame:
    """Rows with arrays of texts and addresses as partitions; addresses count only if there are as many."""
    matched = F.size("urls") == F.size("texts")
    urls = F.when(matched, F.col("urls")).otherwise(F.transform("texts", lambda _: F.lit(None).cast("string")))
    return rows.select("document_id", F.posexplode(F.arrays_zip(F.col("texts").alias("text"), urls.alias("url"))).alias("partition_index", "p")).select("document_id", "partition_index", "p.text", "p.url")


def partition_texts(asked: DataFrame, live: DataFrame) -> DataFrame:
    """Live texts of the partitions asked for; null where there is none."""
    return asked.join(live.select("document_id", "partition_index", "text"), ["document_id", "partition_index"], "left")


def routed_texts(asked: DataFrame, nodes: DataFrame, live: DataFrame) -> DataFrame:
    """The same over several nodes: a document's prefix says whose table answers. Nodes are few."""
    own = asked.join(few(nodes), F.startswith(asked["document_id"], nodes["prefix"]), "left")
    return own.join(live, ["node", "document_id", "partition_index"], "left")


def files(spark: SparkSession, texts: str | None = None, lines: str | None = None) -> DataFrame:
    """Documents from whole text files and from JSON lines with a `text`."""
    out = None
    if texts:
        out = spark.read.text(texts, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("origin"))
    if lines:
        own = read_json(spark, lines, T.StructType([T.StructField("text", T.StringType())])).select("text", F.col("_metadata.file_name").alias("origin")).where("text IS NOT NULL")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise StoreError("no files named")
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha"))


def write_split(docs: DataFrame, path: str) -> None:
    """A corpus written once, parted by its held-out flag."""
    docs.withColumn("split", F.when(F.col("held_out"), "held_out").otherwise("train")).drop("held_out").write.partitionBy("split").mode("errorifexists").parquet(path)


def shard(spark: SparkSession, path: str, tokenizer: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A corpus's tokens under one tokenizer, made when first asked for."""
    target = f"{path}/tokenizer={tokenizer}"
    if not exists(spark, f"{target}/_SUCCESS"):
        make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def token_slice(tokens: DataFrame, start: int, length: int, position: str = "at") -> DataFrame:
    return tokens.where(F.col(position).between(start, start + length - 1))


def slice_of(spec: str) -> tuple[str, int, int, int]:
    """`DOCUMENT:PARTITION:OFFSET:LENGTH`, from the right, as ids may hold colons."""
    parts = spec.rsplit(":", 3)
    if len(parts) != 4 or not all(p.isdigit() for p in parts[1:]) or int(parts[3]) < 1:
        raise StoreError(f"not a slice: {spec}")
    return parts[0], int(parts[1]), int(parts[2]), int(parts[3])


def checked_index(keys: DataFrame, info: DataFrame) -> DataFrame:
    """An index's entries, or an error if there are not as many as it says or their vectors differ in length."""
    found = keys.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("vector")).alias("kinds")).first()
    said = info.first()["entries"]
    if found["n"] != said or found["kinds"] > 1:
        raise StoreError(f"index has {found['n']} entries of {found['kinds']} lengths, {said} expected")
    return keys


def strong_index(info: DataFrame, floor: float = 0.5) -> DataFrame:
    """What is known of an index, or an error if its model has memorised too little of it or was made from another corpus.

    info: one row (memorised, chain, expected_chain).
    """
    row = info.first()
    if row["memorised"] is None or row["memorised"] < floor:
        raise StoreError(f"the index's model has memorised {row['memorised']} of it, {floor} needed")
    if row["chain"] != row["expected_chain"]:
        raise StoreError(f"the index was made from {row['chain']}, not from {row['expected_chain']}")
    return info


def retried(call: Callable[[], object], tries: int = 5, first: float = 0.5, most: float = 30.0, pause: Callable[[float], None] = time.sleep):
    """What a call gives, tried again after an error with pauses that double up to a bound; the last error is raised."""
    wait = first
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            pause(wait)
            wait = min(2 * wait, most)


def registry(slots: DataFrame, loose: DataFrame) -> DataFrame:
    """Listed and unlisted packs together; a slot without a current one takes its first."""
    every = slots.unionByName(loose.join(slots.select("sha"), "sha", "left_anti"), allowMissingColumns=True)
    once = Window.partitionBy("slot", "created", "sha").orderBy(F.desc_nulls_last("current"))
    every = every.withColumn("_once", F.row_number().over(once) == 1)
    # A row for each slot is counted before it meets the packs, so no window holds a hot slot.
    own = every.groupBy(F.col("slot").alias("_slot")).agg(F.bool_or(F.coalesce("current", F.lit(False))).alias("_has"), F.min(F.struct("created", "sha")).alias("_first"))
    first = F.struct("created", "sha").eqNullSafe(F.col("_first")) & F.col("_once")
    joined = every.join(own, F.col("slot").eqNullSafe(F.col("_slot")))
    return joined.withColumn("current", F.coalesce("current", F.lit(False)) | (~F.col("_has") & first)).drop("_once", "_slot", "_has", "_first")


def catalog(rows: DataFrame) -> DataFrame:
    """Catalog rows by when they were last updated, those never so last."""
    return rows.orderBy(F.desc_nulls_last("updated"), "name")


def slim(events: DataFrame, keep: list[str]) -> DataFrame:
    """Recorded events with the kept columns alone."""
    return events.select(*[c for c in keep if c in events.columns])


def packed_floats(x: Column) -> Column:
    """Floats as base64 of little-endian bytes, for exchange."""
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())

    return run(x)


def unpacked_floats(x: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(base64.b64decode(v), "<f4"))

    return run(x)


def split_lines(pieces: DataFrame, by: str, order: str, piece: str) -> DataFrame:
    """Messages from pieces of a line-delimited stream: a message may span pieces; an unfinished last one is left out."""
    cut = pieces.select(by, order, F.posexplode(F.split(F.col(piece), "\n")).alias("_i", "_part"))
    v = Window.partitionBy(by).orderBy(order, "_i")
    numbered = cut.withColumn("line", F.sum((F.col("_i") > 0).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    lines = numbered.groupBy(by, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_i", "_part"))), lambda x: x["_part"]), "").alias("message"))
    last = Window.partitionBy(by)
    return lines.withColumn("_last", F.max("line").over(last)).where("line < _last").drop("_last")
