"""Projections and predicates over traces, spans, ledgers and nodes, as reports and guards use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bounds import few


def dominant(shares: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    """The strand with the largest share, the first of equals, if that is large enough."""
    best = shares.groupBy(*by).agg(F.min_by("strand", F.struct(-F.col("share"), F.col("strand"))).alias("strand"), F.max("share").alias("share"))
    return best.where(F.col("share") >= threshold)


def asked(shares: DataFrame, by: list[str]) -> DataFrame:
    """How many strands but the commons were opened, and whether the commons leads."""
    commons = F.max(F.when(F.col("strand") == "commons", F.col("gate")))
    return shares.groupBy(*by).agg(F.count_if(F.col("open") & (F.col("strand") != "commons")).alias("asked"), F.coalesce(F.max("gate") <= commons, F.lit(False)).alias("commons_leads"))


def attention(tokens: DataFrame, text: str, end: int) -> DataFrame:
    """Pairs of positions of one document, the second not after the first; texts are windows of bounded length."""
    w = Window.partitionBy(text).orderBy("pos")
    own = tokens.withColumn("_doc", F.sum((F.col("token") == end).cast("int")).over(w))
    a, b = own.select(text, "_doc", F.col("pos").alias("t")), own.select(text, "_doc", F.col("pos").alias("s"))
    return a.join(b, [text, "_doc"]).where("s <= t").select(text, "t", "s")


def cells(snapshot: DataFrame, indexed: DataFrame, learned: DataFrame) -> DataFrame:
    """A node's partitions and how far each has come: pending, indexed or learned."""
    i, n = indexed.select("document_id", "partition_index", F.lit(True).alias("_i")), learned.select("document_id", "partition_index", F.lit(True).alias("_l"))
    j = snapshot.join(i, ["document_id", "partition_index"], "left").join(n, ["document_id", "partition_index"], "left")
    return j.select("document_id", "partition_index", F.when(F.col("_l") & F.col("_i"), "learned").when(F.col("_i"), "indexed").otherwise("pending").alias("state"))


def same_world(a: Column, b: Column, default: str = "tiny") -> Column:
    return F.coalesce(a, F.lit(default)) == F.coalesce(b, F.lit(default))


def distinctive(spans: DataFrame) -> DataFrame:
    """Verified verbatim spans that more than shared n-grams make."""
    return spans.where("kind = 'verbatim' AND distinctiveness > 0 AND status = 'verified'")


def by_fact(rows: DataFrame, name: str, fact: str = "fact") -> DataFrame:
    """Ledger rows of a fact by its id or the end of it."""
    return rows.where((F.col(fact) == name) | F.endswith(fact, F.lit(name)))


def guarded(df: DataFrame, bound: dict[str, str]) -> DataFrame:
    """`df`, whose read fails where a column is not what the row must be bound to."""
    for column, value in bound.items():
        df = df.withColumn(column, F.when(F.col(column) == value, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} is not {value}: "), F.coalesce(column, F.lit("null"))))))
    return df


def trace_table(traces: DataFrame, limit: int) -> DataFrame:
    """The generated tokens' rows with their first citation, the first `limit` of them."""
    return traces.where("NOT is_prompt").select("k", "text", "confidence", F.get("citations", F.lit(0)).alias("citation")).orderBy("k").limit(limit)


def kept_and_dropped(sources: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Every source once, with whether it was kept."""
    flags = kept.select(key, F.lit(True).alias("_k")).distinct()
    return sources.dropDuplicates([key]).join(flags, key, "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")


def attributed(sources: DataFrame, influence: DataFrame, citations: DataFrame) -> DataFrame:
    """Sources with their measured influence, the first of repeated keys, and what was cited of them."""
    w = Window.partitionBy("partition").orderBy("place")
    first = influence.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("partition", "influence")
    cited = citations.groupBy("partition").agg(F.count(F.lit(1)).alias("tokens"), F.sum("weight").alias("weight"))
    return sources.join(first, "partition", "left").join(cited, "partition", "left").fillna(0, ["tokens", "weight"])


def controls(outcomes: DataFrame) -> DataFrame:
    """Per group of control prompts: how many, answered exactly, cited, and the mean confidence."""
    return outcomes.groupBy("group").agg(F.count(F.lit(1)).alias("prompts"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("cited").cast("double")).alias("cited"), F.avg("confidence").alias("confidence"))


def answer_rows(credits: DataFrame) -> DataFrame:
    """A strand's part of an answer, by bits, and what of it was cited, in order of first use."""
    worth = F.try_divide(F.sum(F.col("credit") * F.col("bits")), F.sum(F.sum("bits")).over(Window.partitionBy()))
    lines = F.transform(F.array_sort(F.collect_set(F.when(F.col("cited").isNotNull(), F.struct("first", "cited")))), lambda x: x["cited"])
    return credits.groupBy("strand").agg(worth.alias("part"), F.array_distinct(lines).alias("cited"))


def on_breaks(cited: DataFrame, parts: DataFrame) -> DataFrame:
    """Citations, and how many of them lie on a break past their partition's end."""
    return cited.join(parts.select("row", "token_count"), "row").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("offset") >= F.col("token_count")).alias("on_breaks"))


def greedy_rate(predictions: DataFrame) -> DataFrame:
    """The share of facts whose every predicted token is right."""
    facts = predictions.groupBy("node", "fact").agg(F.bool_and(F.col("predicted") == F.col("expected")).alias("right"))
    return facts.groupBy("node").agg(F.count(F.lit(1)).alias("facts"), F.avg(F.col("right").cast("double")).alias("greedy"))


def manifest_hash(strands: DataFrame) -> DataFrame:
    """One digest over all strands in order, and the sum of their versions."""
    from tessera.functions.text import sha256

    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("strand", "version", "sha"))), lambda s: F.concat_ws("\t", s["strand"], s["version"].cast("string"), s["sha"])), "\n")
    return strands.agg(sha256(lines).alias("manifest"), F.sum("version").alias("version"))


def relative(states: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """States described by their centred cosines to anchors, which are a fixed few: (key, anchor, value)."""
    from tessera.functions.scores import cosine

    a = anchors.select(F.col("anchor"), F.col("vector").alias("_a"))
    met = states.join(few(a)).select(key, "anchor", cosine(F.col("vector"), F.col("_a")).alias("_c"))
    return met.select(key, "anchor", (F.col("_c") - F.avg("_c").over(Window.partitionBy(key))).alias("value"))


def context(sources: DataFrame, prompt: Column, end: int) -> DataFrame:
    """A context: end mark, source, end mark, source and so on, then the prompt; the sources of a context are bounded by its budget."""
    mark = F.array(F.lit(end).cast("long"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "tokens"))), lambda s: F.concat(mark, s["tokens"])))
    return sources.groupBy("context").agg(F.concat(parts, mark, F.first(prompt)).alias("tokens"))
