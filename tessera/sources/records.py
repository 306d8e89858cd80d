"""Records of what was generated, measured and profiled, as nested rows in Parquet.

A generation is a row with its tokens, each with its citations, and its spans. A grounding record lies beside the
generations, by generation. A profile is a thread's centroids of one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import StoreError, exists

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CITATION = struct(place=LONG, row=LONG, weight=DOUBLE, score=DOUBLE, confidence=DOUBLE)
TOKEN = struct(k=LONG, token=LONG, citations=T.ArrayType(CITATION))
SPAN = struct(span=LONG, start=LONG, length=LONG, row=LONG, offset=LONG)
GENERATION = struct(generation_id=STRING, tokens=T.ArrayType(TOKEN), spans=T.ArrayType(SPAN))
GROUNDING = struct(generation_id=STRING, steps=T.ArrayType(struct(step=LONG, aligned=T.BooleanType())))
PROFILE = struct(thread=STRING, version=STRING, centroids=T.ArrayType(struct(centroid=LONG, mass=DOUBLE, vector=T.ArrayType(DOUBLE))))


def listed(df: DataFrame, by: list[str], item: T.StructType, name: str) -> DataFrame:
    """The rows of each group as one array of structs, in the order of the structs' fields. A group is one record."""
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in item.fields])
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias(name))


def generations(tokens: DataFrame, citations: DataFrame, spans: DataFrame, gen: str = "generation_id") -> DataFrame:
    """GENERATION rows of tokens (gen, k, token), citations (gen, k, place, ...) and spans (gen, span, ...)."""
    cited = listed(citations, [gen, "k"], CITATION, "citations")
    none = F.array().cast(T.ArrayType(CITATION))
    held = tokens.join(cited, [gen, "k"], "left").withColumn("citations", F.coalesce("citations", none))
    own = listed(held, [gen], TOKEN, "tokens").join(listed(spans, [gen], SPAN, "spans"), gen, "left")
    return own.select(F.col(gen).cast("string").alias("generation_id"), "tokens", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"))


def save(records: DataFrame, path: str, schema: T.StructType) -> None:
    """Append records of a schema; other columns are left out, missing ones are an error."""
    missing = [f.name for f in schema.fields if f.name not in records.columns]
    if missing:
        raise StoreError(f"records lack {', '.join(missing)}")
    records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, value: str | None = None) -> DataFrame:
    """Saved records, all or those of one key; the key reaches the scan."""
    if not exists(spark, path):
        raise StoreError(f"no records in {path}")
    found = spark.read.schema(schema).parquet(path)
    return found if key is None else found.where(F.col(key) == value)


def grounding_path(generations_path: str) -> str:
    """Where the grounding records of a folder of generations lie."""
    return f"{generations_path.rstrip('/')}-grounding"
