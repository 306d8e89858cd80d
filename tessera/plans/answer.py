"""Answer: prompts to neighbours, weights, mixture, choice, citations and spans, a whole table of prompts at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cite, index, mix


def retrieved(queries: DataFrame, entries: DataFrame, k: int, tau: float) -> DataFrame:
    """Ranked, weighted neighbours of every query: entries bring value, row, offset and loss."""
    found = index.blocked_neighbours(queries, entries, k)
    columns = [c for c in entries.columns if c not in ("vector", "grp")]
    return mix.weights(found.join(entries.select(columns), "entry"), ["query"], tau)


def answered(neighbours: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """The token of every query: retrieval mixed with the model's probabilities (query, value, p), the lowest of equals."""
    return mix.argmax(mix.interpolated(model, mix.distribution(neighbours, ["query"]), ["query"], "value", share), ["query"], "value", "p")


def supported(neighbours: DataFrame, choice: DataFrame, generation: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations and spans of the chosen tokens: generation says which generation and position a query is."""
    picked = neighbours.join(choice.select("query", F.col("value").alias("token")), "query").join(generation, "query")
    marked = picked.withColumn("matches", F.col("value") == F.col("token"))
    return cite.citations(marked, parts), cite.spans(cite.chains(marked, parts), parts)


def by_node(hits: DataFrame, k: int, tau: float, floor: float) -> DataFrame:
    """Several nodes' hits pooled, their gates, which of them stay open, and their weights over those."""
    pooled = mix.pooled(hits, ["query"], k, tau)
    gates = pooled.groupBy("query", "strand").agg(F.sum("weight").alias("gate"))
    return mix.renormalised(mix.opened(gates, ["query"], floor), ["query"])
