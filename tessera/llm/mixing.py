"""Mixing of sources to target weights: capped water-filling, and seeded whole and fractional repetitions.

Every source is to give a share of the mix by its weight, but no more than some multiple of its size. Sources that would pass
that are clamped to it, and what they leave is shared by the others' weights again, until none is above. A source is then
taken whole as often as it fits into its target, and once more in part: its documents in a seeded order, up to the words that
are left. Where that ends is found from sums by range of the order, so that no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, in_chunks, map_batches, ranked, text_bytes, word_spans

#: Production parameters of op11: weights of the sources in their order, repeating; the mix's share of all words; most epochs.
WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), Fraction(3, 2), Fraction(2), 11
#: A word, for sizes.
WORD = r"[^\x20\x09-\x0D]+"
#: Digits of the order's key: a document's place in its source.
KEY_DIGITS, RANGE_DIGITS = 32, 7


def size_of(text: Column) -> Column:
    """A text's words. Null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def key_of(doc_id: Column, size: Column, seed: int) -> Column:
    """A document's place in the seeded order; rows of one id and size share one. A null id is empty."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")), 256), 1, KEY_DIGITS)


def weighed(scratch: Scratch, sized: DataFrame, weights: Sequence[int]) -> DataFrame:
    """A row for each source: source, source_size, rows, weight. Sources are in code-point order, null last, in ranges."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = scratch.save(totals.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "totals")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    return scratch.save(placed.join(firsts, "_part").select("source", "source_size", "rows", turn.alias("weight")), "sources")


def big(value: int | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(38,0)")


def level(sources: DataFrame, share: Fraction, epochs: Fraction) -> tuple[int, int]:
    """The water level as a fraction: a source gets level x weight, or `epochs` times its size where that is less.

    A round clamps every source that the level would bring above its limit and shares what they leave among the others; only
    sums reach the driver. Levels rise, so that what is clamped stays so; where every source is clamped, the level is (1, 0).
    Sizes are in units of 1 / (denominators of `share` and `epochs`), so that all is exact.
    """
    unit = share.denominator * epochs.denominator
    cap = big(F.col("source_size")) * big(int(epochs * unit))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped, top, bottom = -1, 0, 1
    while True:
        above = big(F.col("weight")) * big(top) > cap * big(bottom)
        sums = sources.agg(F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if sums["n"] == clamped:
            return top, bottom
        clamped, top, bottom = sums["n"], int(share * unit) * total - int(sums["capped"] or 0), sums["open"] or 0
        if not bottom:
            return 1, 0


def targets(sources: DataFrame, share: Fraction = SHARE, epochs: Fraction = EPOCHS) -> DataFrame:
    """`sources` with each one's target in words, as a double, and with `words`, the target as a whole number."""
    top, bottom = level(sources, share, epochs)
    unit = share.denominator * epochs.denominator
    limit, weight = big(int(epochs * unit)) * big(F.col("source_size")), big(F.col("weight"))
    held = F.lit(True) if not bottom else weight * big(top) > limit * big(bottom)
    poured = (weight * big(top)).cast("double") / F.lit(float(bottom * unit or 1))
    target = F.when(held, limit.cast("double") / F.lit(float(unit))).otherwise(poured)
    return sources.withColumn("target", target).withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.floor(limit / big(unit))).cast("long"))


def edges(sized: DataFrame, sources: DataFrame, most_rows: int) -> DataFrame:
    """Where each source's last, partial repetition ends: source, edge (a key), rest (words for the rows with that key).

    Sizes are summed by range of the order, then by key in the range in which the words run out. There are about as many
    ranges as the largest source has rows in each, so that both sums run over the root of its rows.
    """
    digits = F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("long")
    ranges = isqrt(most_rows) + 1
    dealt = sized.withColumn("_range", F.floor(digits * ranges / F.lit(16**RANGE_DIGITS)))
    want = sources.select("source", "extra")

    def crossing(sums: DataFrame, order: str) -> DataFrame:
        """Of each source the row in which its sums pass `extra`, with `extra` less the sums before it."""
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sums.withColumn("_left", F.col("extra") - before).where("_left >= 0 AND _left < _sum").drop("_sum", "extra")

    same = lambda a, b: a.join(b.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    by_range = crossing(same(dealt.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), want), "_range")
    there = by_range.select(F.col("source").alias("_source"), F.col("_range").alias("_at"), F.col("_left").alias("extra"))
    inside = dealt.join(there, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at")))
    by_key = crossing(inside.groupBy("source", "key", "extra").agg(F.sum("size").alias("_sum")), "key")
    return by_key.select("source", F.col("key").alias("edge"), F.col("_left").alias("rest"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: Fraction = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """`docs` with source_size, target (of the row's source) and taken: the words that the mix takes of the row.

    `weights` are positive whole numbers, repeated over the sources in code-point order, null as a source of its own at the
    end; the mix has `share` times all words, a source at most `epochs` times its own. taken is the row's size times its
    source's whole repetitions, and once more for the rows that come first in a seeded order; one row at most of each source
    is taken in part, so that a source's words are its target, rounded. Of rows with one id and size it doesn't matter
    which is taken; null ids are ids like others; a null size is none. Empty texts and sources have a target of nothing.
    `docs` is read several times and should be a table. Columns with the new names are replaced; an empty table gives no rows.
    """
    if not weights or min(weights) < 1 or any(w != int(w) for w in weights):
        raise ValueError("weights must be positive whole numbers")
    share, epochs = Fraction(share), Fraction(epochs)
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("source_size", "target", "taken")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    key = key_of(F.col(id_col), size, seed)
    sized = docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    sources = targets(weighed(scratch, sized, weights), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("extra", F.col("words") - F.col("whole") * F.col("source_size"))
    most = sources.agg(F.max("rows")).first()[0] or 0
    edge = edges(sized, sources, most).withColumnRenamed("source", "_source")
    named = {c: free_name(docs, f"_mix_{c}") for c in ("source", "key", "size", "whole", "edge", "rest", "salt", "place")}
    plan = sources.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias(named["source"]), "source_size", "target", *[F.col(c).alias(named[c]) for c in ("whole", "edge", "rest")])
    plan = scratch.save(plan, "plan")
    n = {k: F.col(v) for k, v in named.items()}
    rows = docs.withColumn(named["key"], key).withColumn(named["size"], size).join(plan, F.col(source_col).eqNullSafe(n["source"]))
    on_edge = F.coalesce(n["key"] == n["edge"], F.lit(False))
    first = F.coalesce(n["key"] < n["edge"], F.lit(False))
    clear = rows.where(~on_edge).withColumn("taken", n["size"] * (n["whole"] + F.when(first, 1).otherwise(0)))
    # Rows with the edge's key are repeated rows of one document of each source, mostly one.
    tied = scratch.save(rows.where(on_edge).withColumn(named["salt"], F.monotonically_increasing_id()), "edges")
    place = ranked(tied, [named["source"]], [named["salt"]], named["place"], tied.count())
    part = F.greatest(F.lit(0), F.least(n["size"], n["rest"] - n["place"] * n["size"]))
    return clear.unionByName(place.withColumn("taken", n["size"] * n["whole"] + part).drop(named["salt"], named["place"])).select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", "taken")


def repeated(docs: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """The mix itself: each row of `mixed` as often as it is taken, with `copy` from 0; the last copy's text has the words left over."""
    left = free_name(docs, "_left")
    copies = F.ceil(F.col("taken") / F.col(size_col)).cast("int")
    rows = docs.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    rows = rows.withColumn(left, F.least(F.col(size_col), F.col("taken") - F.col("copy") * F.col(size_col)))
    cut = rows.where(F.col(left) < F.col(size_col))

    def run(batches):
        for batch in in_chunks(batches, text_col):
            data, at = text_bytes(batch.column(text_col))
            starts, ends = word_spans(data, at)
            last = np.searchsorted(starts, at[:-1]) + batch.column(left).to_numpy() - 1
            text = pa.array([bytes(data[a : ends[k]]).decode() for a, k in zip(at[:-1], last, strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, text)

    return rows.where(F.col(left) == F.col(size_col)).unionByName(map_batches(cut, run, cut.schema)).drop(left)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return mixed(Scratch(spark, "sizes").save(docs, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), keyed AS (
  SELECT *, sha256('11:' || coalesce(doc_id::VARCHAR, '') || ':' || size)[1:32] AS key FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS capped, true AS moved FROM sources
  UNION ALL
  SELECT k + 1, source, source_size, weight, above, bool_or(above <> capped) OVER ()
  FROM (SELECT *, capped OR weight * (3 * sum(source_size) OVER () - coalesce(sum(4 * source_size) FILTER (capped) OVER (), 0)) > 4 * source_size * coalesce(sum(weight) FILTER (NOT capped) OVER (), 0) AS above FROM rounds)
  WHERE moved
), filled AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size
    ELSE (weight * (3 * sum(source_size) OVER () - coalesce(sum(4 * source_size) FILTER (capped) OVER (), 0)))::DOUBLE / (2 * sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM rounds WHERE k = (SELECT max(k) FROM rounds)
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole, floor(target + 0.5)::BIGINT AS words FROM filled
), ordered AS (
  SELECT k.doc_id, k.size, k.source, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS extra,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM ordered
"""
