"""Plans of windows, prompts and samples: seeded, ordered, reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(facts: DataFrame, document: str, order: str, fact: str) -> DataFrame:
    """Facts a turn at a time, within a turn newest documents first: `turn`, to order by with the document descending."""
    return facts.withColumn("turn", F.row_number().over(Window.partitionBy(document).orderBy(fact))).withColumn("newest", -F.col(order))


def seeded(df: DataFrame, key: Column, number: int) -> DataFrame:
    """The first rows by a seeded key."""
    return df.orderBy(key).limit(number)


def quota(df: DataFrame, by: list[str], order: list[str], number: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= number).drop("_k")


def share(total: int, parts: int, at: int) -> int:
    """How much of a total the part at a place gets, the first ones one more."""
    return total // parts + (at < total % parts)


def shared_out(total: int, parts: Column, at: Column) -> Column:
    """`share` over columns."""
    return F.floor(F.lit(total) / parts).cast("long") + (at < F.lit(total) % parts).cast("long")


def grid(streams: DataFrame, by: str, length: str, offset: Column, size: int) -> DataFrame:
    """Starts of training windows: a grid with an offset of its own for each stream."""
    starts = F.when(F.col(length) - size - 1 >= offset, F.sequence(offset, F.col(length) - size - 1, F.lit(size).cast("long")))
    return streams.select(by, F.explode(starts).alias("start"))


def batches(windows: DataFrame, key: Column, size: int, by: list[str]) -> DataFrame:
    """Windows in the order of a seeded key, in batches of a size; the last one is filled up from the first windows."""
    w = Window.partitionBy(*by)
    placed = windows.withColumn("_i", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    missing = F.pmod(-F.col("_n"), F.lit(size))
    again = F.when(F.col("_i") < missing, F.array(F.col("_i"), F.col("_n") + F.col("_i"))).otherwise(F.array(F.col("_i")))
    full = placed.select(*windows.columns, F.explode(again).alias("_at"))
    return full.withColumn("batch", F.floor(F.col("_at") / size)).withColumn("place", F.col("_at") % size).drop("_at")


def planned(steps: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Which corpus each step reads, by whole-number weights in turn, and its how-many-th window of that corpus it is."""
    total, at, cases = sum(weights.values()), 0, None
    for name, weight in weights.items():
        inside = F.pmod(F.col("step"), F.lit(total)).between(at, at + weight - 1)
        number = F.floor(F.col("step") / total) * weight + F.pmod(F.col("step"), F.lit(total)) - at
        row = F.struct(F.lit(name).alias("corpus"), number.alias("window"))
        cases = F.when(inside, row) if cases is None else cases.when(inside, row)
        at += weight
    return steps.select("step", cases.alias("_c")).select("step", "_c.corpus", "_c.window")


def schedule(lists: dict[str, int], every: dict[str, int], rounds: DataFrame) -> DataFrame:
    """A panel's order: each `round` one of every list that is due, cycling through it: round, place, list, item."""
    rows, found = rounds.select("round"), None
    for place, (name, size) in enumerate(lists.items()):
        due = rows.where(F.col("round") % every.get(name, 1) == 0)
        own = due.select("round", F.lit(place).alias("place"), F.lit(name).alias("list"), (F.floor(F.col("round") / every.get(name, 1)) % size).alias("item"))
        found = own if found is None else found.unionByName(own)
    return found


def collage(sentences: DataFrame, documents: int, by: str, document: str, order: str, text: str) -> DataFrame:
    """Sentence k of the k-th document, around and around: pieces of many documents in one text."""
    w = Window.partitionBy(by)
    turn = sentences.withColumn("_d", F.dense_rank().over(w.orderBy(document)) - 1).where(F.col("_d") < documents)
    picked = turn.where(F.pmod(F.col(order), F.lit(documents)) == F.col("_d"))
    return picked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, document, text))), lambda x: x[text]), " ").alias("text"))


def listed(tokens: Column) -> Column:
    """A list of tokens as one string, different for different lists; that of two lists in a row is their strings in a row."""
    return F.array_join(F.transform(tokens, lambda x: F.concat(F.lit("\0\2"), F.replace(x, F.lit("\0"), F.lit("\0\1")))), "")


def joined_again(units: DataFrame, documents: DataFrame, by: str, order: str, tokens: str, whole: str) -> DataFrame:
    """Whether a document's units, put together, are its tokens again. A unit travels as a string and a document as a digest."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    told = units.select(by, F.struct(order, listed(F.col(tokens)).alias("_unit")).alias("_unit"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list("_unit")), lambda x: x["_unit"]), "")
    found = told.groupBy(by).agg(digest(parts).alias("_parts"))
    return found.join(documents.select(by, digest(listed(F.col(whole))).alias("_whole")), by).select(by, (F.col("_parts") == F.col("_whole")).alias("exact"))


def next_unfed(documents: DataFrame, fed: DataFrame, order: str, number: int) -> DataFrame:
    return documents.join(fed.select("document_id"), "document_id", "left_anti").orderBy(order).limit(number)


def newest(documents: DataFrame, order: str, number: int = 1) -> DataFrame:
    return documents.orderBy(F.desc(order)).limit(number)
