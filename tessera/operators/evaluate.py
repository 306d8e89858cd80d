"""Evaluation: outcomes and their roll-ups, fidelity, histograms, matrices, grounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.stats import auroc, mean, pearson, rate
from tessera.functions.text import words


def fact_scores(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per fact: how many of its answer positions have the right partition first, the right offset, the right citation; confidence.

    facts: (fact, row, first, length); answers: (fact, i, top_row, top_offset, cited_row, confidence), i from 0.
    """
    own = answers.join(facts, "fact").where(F.col("i") < F.col("length"))
    right = F.col("top_row") == F.col("row")
    n = F.greatest(F.max("length"), F.lit(1))
    return own.groupBy("fact").agg(
        (F.count_if(right) / n).alias("partition_at_1"), (F.count_if(right & (F.col("top_offset") == F.col("first") + F.col("i"))) / n).alias("offset_at_1"),
        (F.count_if(F.col("cited_row") == F.col("row")) / n).alias("cited_at_1"), mean(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
    )


def lambda_metrics(outcomes: DataFrame, by: str = "lambda") -> DataFrame:
    """Per setting: facts, exact share, citation overall and on exact answers, coverage, confidence."""
    return outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("facts"), mean(F.col("exact").cast("double")).alias("exact"), mean(F.col("citation")).alias("citation"),
        F.avg(F.when(F.col("exact"), F.col("citation"))).alias("citation_on_exact"), mean(F.col("covered").cast("double")).alias("covered"), mean(F.col("confidence")).alias("confidence"),
    )


def fidelity(shares: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """1 less half the distance between shares and an even split among those who knew the token alone; none where nobody did.

    shares: (strand, share or null, alone): a strand that knew but has no share counts with 0.
    """
    w = Window.partitionBy(*by)
    knew = F.coalesce(F.col("alone") >= threshold, F.lit(False))
    number = F.count_if(knew).over(w)
    even = F.when(knew, F.try_divide(F.lit(1.0), number.cast("double"))).otherwise(0.0)
    rows = shares.withColumn("_d", F.abs(F.coalesce("share", F.lit(0.0)) - even)).withColumn("_n", number).where("_n > 0")
    return rows.groupBy(*by).agg((1 - F.sum("_d") / 2).alias("fidelity"))


def arm_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Prompts, rates over what is known, mean gate, and fidelity as a ratio of sums."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("prompts"), rate(F.col("exact")).alias("exact"), rate(F.col("leads")).alias("leads"), rate(F.col("cited")).alias("cited"),
        F.coalesce(rate(F.col("all_asked")), F.lit(0.0)).alias("all_asked"), mean(F.col("gate")).alias("gate"),
        F.try_divide(F.sum("fidelity_sum"), F.sum("fidelity_tokens").cast("double")).alias("fidelity"),
    )


def tally(rows: DataFrame, by: list[str], hit: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: str, top: int) -> DataFrame:
    """How many rows have each value from 0 to `top`, zeros included."""
    counts = rows.groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(top + 1).select(F.col("id").alias("value")).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def matrix(rows: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """Means of a value by row and column; the columns are given, so that no job has to find them."""
    return rows.groupBy(row).pivot(column, columns).agg(F.avg(value))


def by_world(rows: DataFrame, world: str, hit: str) -> DataFrame:
    """A share by group with the grand total in the same pass."""
    return rows.rollup(world).agg(F.count(F.lit(1)).alias("n"), rate(F.col(hit)).alias("rate"))


def token_f1(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Word overlap of two texts as multisets: F1; pairs without a word have no row, and those of equal keys are one.

    Words are counted where their texts are, so that only texts are shuffled.
    """
    texts = pairs.groupBy(*keys).agg(F.collect_list(a).alias("_a"), F.collect_list(b).alias("_b"))
    lists = texts.select(*keys, *[F.flatten(F.transform(c, words)).alias(c) for c in ("_a", "_b")])
    schema = T.StructType([*[pairs.schema[k] for k in keys], T.StructField("f1", T.DoubleType())])

    def run(batches):
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("_a", "_b")]
            codes = pa.concat_arrays([pc.list_flatten(batch.column(c)) for c in ("_a", "_b")]).dictionary_encode()
            each, n = max(len(codes.dictionary), 1), batch.num_rows
            row = np.repeat(np.tile(np.arange(n, dtype=np.int64), 2), np.concatenate(sizes))
            keyed = np.split(row * each + codes.indices.to_numpy(zero_copy_only=False), [int(sizes[0].sum())])
            (one, na), (two, nb) = [np.unique(x, return_counts=True) for x in keyed]
            met, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            same, total = np.bincount(met // each, np.minimum(na[i], nb[j]), n), sizes[0] + sizes[1]
            kept = total > 0
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(pa.array(kept)) for k in keys], pa.array(2 * same[kept] / total[kept])], names=schema.names)

    return lists.mapInArrow(run, schema)


def compared(a: DataFrame, b: DataFrame, keys: list[str], equal: str, near: str, by: list[str]) -> DataFrame:
    """Two runs row by row: whether all of one column agree, and how far apart another is at most; a missing row disagrees."""
    left = a.select(*keys, F.col(equal).alias("_ea"), F.col(near).alias("_na"))
    right = b.select(*keys, F.col(equal).alias("_eb"), F.col(near).alias("_nb"))
    met = left.join(right, keys, "full_outer")
    return met.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("_ea") == F.col("_eb"), F.lit(False))).alias("identical"), F.max(F.abs(F.col("_na") - F.col("_nb"))).alias("largest"))


def overlay(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The other table's values where it has them."""
    right = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(right, keys, "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def ahead(tokens: DataFrame, tops: DataFrame, text: str, first: int = 2, last: int = 8) -> DataFrame:
    """Whether a content token 2 to 8 ahead is among a position's likeliest: a range join as an equi join on each offset."""
    reach = tokens.where("role = 'content'").select(text, F.explode(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.col("pos") - d)).alias("pos"), F.col("token").alias("_t"))
    met = tops.join(reach, [text, "pos"], "left")
    return met.groupBy(text, "pos").agg(F.coalesce(F.bool_or(F.array_contains("top", F.col("_t"))), F.lit(False)).alias("held"))


def credit_recall(rows: DataFrame) -> DataFrame:
    """The share of bits-weighted credit that went to opened strands."""
    worth = F.col("bits") * F.col("credit")
    return rows.where("strand <> 'commons'").agg(F.try_divide(F.sum(F.when(F.col("open"), worth).otherwise(0.0)), F.sum(worth)).alias("recall"))


def first_gate(rows: DataFrame, text: str) -> DataFrame:
    """At the first position of each text: the largest gate, and whether all were asked."""
    first = rows.withColumn("_first", F.min("position").over(Window.partitionBy(text))).where(F.col("position") == F.col("_first"))
    return first.groupBy(text).agg(F.max("gate").alias("gate"), F.bool_and("open").alias("all_asked"))


def grounding_rows(traces: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Traces joined to measurements by step; the last measured row has no trace. `aligned` is false where tokens differ."""
    t = traces.withColumnRenamed("token", "_token")
    joined = measured.join(t, [*keys, "step"], "left")
    return joined.withColumn("aligned", F.col("_token").isNull() | (F.col("_token") == F.col("token"))).drop("_token")


def grounding_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correlations of confidence and agreement with influence, its mean by citation, and how risk tells uncited tokens."""
    cited = lambda flag: F.avg(F.when(F.col("uncited") == flag, F.col("influence")))
    grounded = F.col("verbatim") & (F.col("kind") != "function")
    stats = rows.groupBy(*by).agg(
        F.count_if(F.col("kind") != "function").alias("content"), F.count(F.lit(1)).alias("joined"), pearson(F.coalesce("confidence", F.lit(0.0)), F.col("influence")).alias("confidence_r"),
        pearson(F.coalesce("agreement", F.lit(0.0)), F.col("influence")).alias("agreement_r"), cited(False).alias("influence_cited"), cited(True).alias("influence_uncited"),
        F.avg(F.when(grounded, (F.col("kind") == "grounded").cast("double"))).alias("grounded_share"),
        F.try_divide(F.sum(F.when(~F.col("inside"), F.col("top_weight"))), F.sum("top_weight")).alias("outside_weight"),
    )
    return stats.join(auroc(rows, "risk", "uncited", by).withColumnRenamed("auroc", "risk_auroc"), by, "left")


def agreement_band(rows: DataFrame) -> DataFrame:
    """The 95th percentile of agreement between mismatched pairs and the median of matched ones."""
    return rows.agg(F.percentile(F.when(~F.col("matched"), F.col("agreement")), F.lit(0.95)).alias("low"), F.percentile(F.when(F.col("matched"), F.col("agreement")), F.lit(0.5)).alias("high"))


def best_setting(rows: DataFrame, setting: str, likelihood: Column, default: float) -> DataFrame:
    """The setting of the highest mean likelihood, the default among equals."""
    means = rows.groupBy(setting).agg(F.round(F.avg(likelihood), 9).alias("score"))
    return means.agg(F.max_by(setting, F.struct(F.col("score"), (F.col(setting) == default).cast("int"), -F.col(setting))).alias(setting), F.max("score").alias("score"))


def split_half(rows: DataFrame, by: list[str]) -> DataFrame:
    """The cosine of two halves' sums."""
    a, b = F.col("a"), F.col("b")
    return rows.groupBy(*by).agg(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))
