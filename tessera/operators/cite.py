"""Citations: who supports a token, verbatim spans, markers, verification, credit.

Neighbours are rows (gen, k, token, rank, score, weight, matches, row, offset, loss): at position k of a generation, a
retrieved entry whose value sits at (row, offset) of the partition table (row, document_id, partition_index, token_count).
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scores import confidence
from tessera.functions.text import role, sentence_ended, sha256, starts_word
from tessera.operators.bounds import few


def citable(neighbours: DataFrame, parts: DataFrame) -> DataFrame:
    """Matching neighbours inside their partition: the break past its end is never cited. Partition rows are joined by row."""
    return neighbours.where("matches").join(parts, "row").where(F.col("offset") < F.col("token_count"))


def exact_sum(weight: Column) -> Column:
    """A sum that doesn't depend on the order of the rows, so that equal weights tie; plain where one is no number below 1e9."""
    weight = weight.cast("double")
    whole = F.sum(weight.try_cast("decimal(38,28)")).cast("double")
    return F.when(F.count_if(~(F.abs(weight) < 1e9)) > 0, F.sum(weight)).otherwise(whole)


def citations(neighbours: DataFrame, parts: DataFrame, gen: str = "gen") -> DataFrame:
    """Every partition that supports a token: summed weight, best hit, confidence, and order among the token's citations."""
    best = F.max_by(F.struct("score", "rank", "offset", "loss"), F.struct(F.col("score"), -F.col("rank")))
    groups = citable(neighbours, parts).groupBy(gen, "k", "row").agg(exact_sum(F.col("weight")).alias("weight"), best.alias("best"))
    rows = groups.select(gen, "k", "row", "weight", F.col("best.score").alias("score"), F.col("best.rank").alias("rank"), F.col("best.offset").alias("offset"), confidence(F.col("best.score"), F.col("weight"), F.col("best.loss")).alias("confidence"))
    w = Window.partitionBy(gen, "k").orderBy(F.desc("weight"), F.desc("score"), "row")
    return rows.withColumn("place", F.row_number().over(w))


def chains(neighbours: DataFrame, parts: DataFrame, gen: str = "gen", rank: int = 3, least: int = 3) -> DataFrame:
    """Maximal runs of tokens that follow one partition position by position: islands on the diagonal offset - k."""
    eligible = citable(neighbours, parts).where(F.col("rank") <= rank)
    best = eligible.groupBy(gen, "k", "row", "offset").agg(F.min_by("weight", "rank").alias("weight"), F.min("rank").alias("rank"))
    line = Window.partitionBy(gen, "row", F.col("offset") - F.col("k")).orderBy("k")
    islands = best.withColumn("_island", F.col("k") - F.row_number().over(line)).withColumn("_d", F.col("offset") - F.col("k"))
    runs = islands.groupBy(gen, "row", "_d", "_island").agg(F.min("k").alias("start"), F.count(F.lit(1)).alias("length"), F.min("offset").alias("offset"), F.sum("weight").alias("weight"))
    return runs.where(F.col("length") >= least).drop("_d", "_island")


class Chosen:
    """Spans of a generation, chosen longest first. What comes is no longer than what is chosen, so that it overlaps two of
    these at most: the last that begins no later, and the next one."""

    def __init__(self, most: int):
        self.most, self.starts, self.order, self.rows = most, [], [], []

    def add(self, start: int, length: int, row: int, offset: int, weight: float) -> None:
        at = bisect_right(self.starts, start)
        near = [k for k in self.order[max(at - 1, 0) : at + 1] if start < self.rows[k][0] + self.rows[k][1] and self.rows[k][0] < start + length]
        if not near:
            self.starts.insert(at, start)
            self.order.insert(at, len(self.rows))
            self.rows.append((start, length, row, offset, weight, []))
        elif len(others := self.rows[min(near)][5]) < self.most:
            others.append(row)

    def placed(self) -> list[tuple]:
        return [(i, *self.rows[k]) for i, k in enumerate(self.order)]


def spans(found: DataFrame, parts: DataFrame, gen: str = "gen", most: int = 5) -> DataFrame:
    """Chains chosen greedily without overlap: longest, heaviest, then by place; up to `most` others that overlap are alternatives.

    A chain goes with the first chosen one it overlaps. Chains lie in partitions in the order of choice and are read through
    batch by batch: a task holds a batch and what is chosen of one generation.
    """
    placed = found.join(parts.select("row", "document_id", "partition_index"), "row").where(F.col(gen).isNotNull())
    order = [F.desc("length"), F.desc("weight"), "document_id", "partition_index", "offset"]
    rows = placed.repartition(gen).sortWithinPartitions(gen, *order).select(F.col(gen).alias("gen"), *[F.col(c).cast("long") for c in ("start", "length", "row", "offset")], F.col("weight").cast("double"))
    long_ = T.LongType()
    schema = T.StructType([T.StructField(gen, found.schema[gen].dataType), T.StructField("span", T.IntegerType()), *[T.StructField(c, long_) for c in ("start", "length", "row", "offset")], T.StructField("weight", T.DoubleType()), T.StructField("alternatives", T.ArrayType(long_))])

    def run(batches):
        now, chosen, kind = None, None, None

        def told() -> pa.RecordBatch:
            columns = list(zip(*chosen.placed(), strict=True))
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(columns[0]), kind), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

        for batch in batches:
            kind = batch.column("gen").type
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if chosen is None or key != now:
                    if chosen:
                        yield told()
                    now, chosen = key, Chosen(most)
                chosen.add(*row)
        if chosen:
            yield told()

    return rows.mapInArrow(run, schema)


def span_confidence(chosen: DataFrame, cited: DataFrame, gen: str = "gen") -> DataFrame:
    """A span's weakest and mean confidence: of its partition's citations at its positions, 0 where there is none."""
    at = chosen.select(gen, "span", "row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k"))
    joined = at.join(cited.select(gen, "k", "row", "confidence"), [gen, "k", "row"], "left")
    c = F.coalesce("confidence", F.lit(0.0))
    return joined.groupBy(gen, "span").agg(F.min(c).alias("confidence"), F.avg(c).alias("mean_confidence"))


def distinctiveness(grams: DataFrame, shared: DataFrame, by: list[str]) -> DataFrame:
    """1 less the share of n-grams that several documents have; only groups with an n-gram appear.

    `n`, where n-grams have it, is how often each is there.
    """
    n = F.col("n") if "n" in grams.columns else F.lit(1)
    hit = grams.join(shared.select("key", F.lit(1.0).alias("_hit")), "key", "left")
    return hit.groupBy(*by).agg((1 - F.sum(F.coalesce("_hit", F.lit(0.0)) * n) / F.sum(n)).alias("distinctiveness"))


def markers(chosen: DataFrame, gen: str = "gen") -> DataFrame:
    """Numbers of cited partitions by first use; a partition has one number."""
    first = Window.partitionBy(gen, "row")
    ends = chosen.withColumn("end", F.col("start") + F.col("length") - 1).withColumn("_first", F.min(F.col("start") + F.col("length") - 1).over(first))
    return ends.withColumn("number", F.dense_rank().over(Window.partitionBy(gen).orderBy("_first", "row"))).select(gen, "end", "row", "number")


def summary(tokens: DataFrame, gen: str = "gen") -> DataFrame:
    """Per generation: tokens, covered by a span, supported only, uncited, mean confidence of what has one."""
    return tokens.groupBy(gen).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(F.col("span").isNotNull()).alias("covered"),
        F.count_if(F.col("span").isNull() & ~F.col("uncited")).alias("supported"), F.count_if(F.col("uncited")).alias("uncited"), F.avg("confidence").alias("confidence"),
    )


def verified(cited: DataFrame, live: DataFrame, tokens_of) -> DataFrame:
    """The status of each span against the live partitions: missing, stale, verified, drift or mismatch.

    Spans have document_id, partition_index, sha, offset, tokens and text; `tokens_of` makes the live text's tokens.
    """
    now = live.select("document_id", "partition_index", F.col("text").alias("_text"))
    joined = cited.join(now, ["document_id", "partition_index"], "left")
    tokens = tokens_of(F.col("_text"))
    part = F.slice(tokens, F.col("offset").cast("int") + 1, F.greatest(F.size("tokens"), F.lit(0)))
    inside = (F.col("offset") >= 0) & (F.col("offset") < F.size(tokens))
    status = (
        F.when(F.col("_text").isNull(), "missing").when(sha256(F.col("_text")) != F.col("sha"), "stale").when(~inside, "mismatch")
        .when(part == F.col("tokens"), "verified").when(F.array_join(part, " ") == F.col("span_text"), "drift").otherwise("mismatch")
    )
    return joined.withColumn("status", status).drop("_text")


def owner_of_row(rows: DataFrame, strands: DataFrame) -> DataFrame:
    """The strand whose rows start last at or before a row; none before the first. (strand, first) are a few rows: they
    become one sorted array that every row looks its strand up in.
    """
    marks = few(strands).agg(F.array_sort(F.collect_list(F.struct("first", "strand"))).alias("_marks"))
    before = F.filter("_marks", lambda m: m["first"] <= F.col("row"))
    return rows.join(F.broadcast(marks)).withColumn("owner", F.try_element_at(before, F.lit(-1))["strand"]).drop("_marks")


def row_owner(rows: DataFrame, strands: DataFrame) -> DataFrame:
    """The strand that contains a row, by half-open ranges; strands are few and travel. A row outside all has none."""
    s = strands.select("strand", "first", (F.col("first") + F.col("rows")).alias("_end"))
    return rows.join(few(s), (F.col("row") >= F.col("first")) & (F.col("row") < F.col("_end")), "left").drop("_end", "first")


def word_roles(tokens: DataFrame, text: str, order: str, piece: str) -> DataFrame:
    """Every token's role by the whole word it belongs to."""
    w = Window.partitionBy(text).orderBy(order)
    starts = starts_word(F.col(piece), F.lag(piece).over(w))
    placed = tokens.withColumn("_word", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.groupBy(text, "_word").agg(F.array_sort(F.collect_list(F.struct(order, F.col(piece).alias("p")))).alias("_p"))
    roles = whole.select(text, "_word", role(F.trim(F.array_join(F.transform("_p", lambda x: x["p"]), ""))).alias("role"))
    return placed.join(roles, [text, "_word"]).drop("_word")


def credit(shares: DataFrame) -> DataFrame:
    """Credit and bits of each share: a form token is the commons', a content token each strand's as it supplied it."""
    own = F.when(F.col("role") == "form", (F.col("strand") == "commons").cast("double")).otherwise(F.col("share"))
    return shares.withColumn("credit", own).withColumn("bits", -F.log2(F.greatest(F.col("base"), F.lit(1e-30))))


def weighed_credit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Credit averaged with the tokens' bits as weights."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("bits") * F.col("credit")), F.sum("bits")).alias("credit"))


def sentence_windows(tokens: DataFrame, text: str, order: str, piece: str) -> DataFrame:
    """A sentence number for each token, counted up where a sentence has ended before it.

    Whether one has ended depends on the last piece that is not blank, carried forward by a running last.
    """
    w = Window.partitionBy(text).orderBy(order)
    solid = F.when(F.col(piece).rlike(r"\S"), F.col(piece))
    before = F.last(solid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(sentence_ended(before, F.col(piece)), F.lit(False))
    return tokens.withColumn("sentence", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def followed(advances: DataFrame, by: list[str], margin: int = 2) -> DataFrame:
    """Whom a window followed: (strand, advances, content) to the strand ahead by the margin on most of the content, or those tied."""
    w = Window.partitionBy(*by)
    ranked = advances.where("advances > 0").withColumn("_best", F.max("advances").over(w))
    ranked = ranked.withColumn("_close", (F.col("advances") + margin > F.col("_best")).cast("int"))
    groups = ranked.groupBy(*by).agg(
        F.max("_best").alias("best"), F.max("content").alias("content"), F.sum("_close").alias("close"),
        F.array_sort(F.collect_list(F.when(F.col("_close") == 1, F.col("strand")))).alias("strands"),
    )
    enough = F.col("best") * 2 > F.col("content")
    return groups.select(
        *by, F.when(enough & (F.col("close") == 1), F.get("strands", F.lit(0))).alias("followed"),
        F.when(enough & (F.col("close") > 1), F.col("strands")).otherwise(F.array().cast("array<string>")).alias("tied"),
    )


def followed_credit(shares: DataFrame, decisions: DataFrame, window: list[str], token: list[str]) -> DataFrame:
    """Credit of content tokens that two or more strands hold goes to the follower, or evenly to those tied."""
    rows = shares.join(decisions, window, "left")
    w = Window.partitionBy(*token)
    holds = (F.col("strand") != "commons") & (F.col("credit") > 0)
    pooled = F.sum(F.when(holds, F.col("credit")).otherwise(0.0)).over(w)
    several = (F.count_if(holds).over(w) >= 2) & (F.col("role") == "content")
    there = F.bool_or(F.coalesce(F.col("strand") == F.col("followed"), F.lit(False))).over(w)
    shares_tie = holds & F.array_contains(F.coalesce("tied", F.array().cast("array<string>")), F.col("strand"))
    tied_n = F.count_if(shares_tie).over(w)
    tied_sum = F.sum(F.when(shares_tie, F.col("credit")).otherwise(0.0)).over(w)
    moved = (
        F.when(several & F.col("followed").isNotNull() & there & (F.col("strand") == F.col("followed")), pooled)
        .when(several & F.col("followed").isNotNull() & there & holds, F.lit(0.0))
        .when(several & F.col("followed").isNull() & (tied_n >= 2) & shares_tie, F.try_divide(tied_sum, tied_n.cast("double")))
        .otherwise(F.col("credit"))
    )
    return rows.withColumn("moved", moved).drop("credit", "followed", "tied").withColumnRenamed("moved", "credit")


def kept_sources(sources: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Sources once each, in order of first use."""
    return sources.groupBy(*by, key).agg(F.min(order).alias("first"), F.sum("weight").alias("weight"))


def top_sources(sources: DataFrame, by: list[str], number: int = 16) -> DataFrame:
    """The heaviest sources, earlier use first among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("weight"), "first")
    return sources.withColumn("place", F.row_number().over(w)).where(F.col("place") <= number)


def context_start(tokens: DataFrame, document: str, ends: Column) -> DataFrame:
    """For each position, where its sentence starts and where the one before it does: running lasts over sentence ends."""
    before = Window.partitionBy(document).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("starts", F.coalesce(F.last(F.when(ends, F.col("pos") + 1), ignorenulls=True).over(before), F.lit(0)))
    earlier = Window.partitionBy(document).orderBy("starts").rangeBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("previous", F.coalesce(F.max("starts").over(earlier), F.lit(0)))
