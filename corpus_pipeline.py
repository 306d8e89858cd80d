"""A corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents; each works on all that
its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, free_name
from tessera.llm.decontaminate import decontaminated
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack, sequences
from tessera.llm.quality import THRESHOLD, fit, scored
from tessera.llm.secrets import masked

#: Parameters of the near-duplicate stage.
SIMILAR, TABLES = 80, 11


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is below the classifier's threshold.

    Null texts are judged as empty ones, rows without an id as any other; equal texts share their fate, repeated rows stay
    or go together. Without usable labels every document stays. All columns stay, whatever their names.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return scored(docs, model, name=score).where(F.col(score) >= THRESHOLD).drop(score)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id, once.

    Documents link from a similarity of SIMILAR percent on (op8's own contract has 85), over five-word shingles; with TABLES
    hashes in each collection a pair at just that similarity fails to be a candidate with probability 3e-5.
    Of several rows with that id the one with the least text hash stays (then the least text, then the least of the other
    columns in their order). Empty and null texts are linked with nothing and stay, a row for each id; so do all rows without
    an id. All columns stay, whatever their names; an empty table gives no rows.
    """
    kept = near_duplicates(docs, percent=SIMILAR, tables=TABLES).where("kept").select("doc_id").distinct()
    found = docs.join(kept, "doc_id", "left_semi")
    others = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType)]
    place = free_name(docs, "_first")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", *[F.col(f"`{c}`") for c in others]))
    once = found.withColumn(place, first).where(F.col(place) == 1).drop(place)
    return once.select([F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none; equal texts share their fate. All columns of the rows that stay are as they were.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts; every document stays, repeated rows too.

    Null and empty texts stay as they are. `n_chars` is counted anew where it is a column; all others are as they were.
    """
    clean = masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of training sequences; the last stage.

    A null or empty text is its end id alone, repeated rows are packed as often as they occur, other columns are ignored.
    """
    return pack(docs, keep_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Its stages can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def cleaned(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """The documents that the stages before the last keep, masked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last: a plan with digests, whose tokens `training_sequences` has."""
    scratch = Scratch(spark, "pipeline")
    name, stage = STAGES[-1]
    return scratch.save(stage(spark, cleaned(spark, sf_dir, scratch), sf_dir), f"{len(STAGES) - 1}-{name}")


def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences that `run` plans, with their tokens: sequence_id, ids."""
    return sequences(pack(cleaned(spark, sf_dir, Scratch(spark, "pipeline"))))
