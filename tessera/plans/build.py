"""Build: documents to partitions, tokens, transitions and an index with its ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import corpus, index, ledger


@dataclass
class Built:
    """The tables of one version."""

    partitions: DataFrame
    tokens: DataFrame
    entries: DataFrame
    shared: DataFrame
    stats: DataFrame
    snapshot: DataFrame


def build(docs: DataFrame, document: str, text: str, loss: Column, entropy: Column, excluded: DataFrame | None = None) -> Built:
    """The tables of an index over `docs` less those excluded; loss and entropy of a transition are columns over its row.

    An entry is a transition whose key is a position and whose value is the next token; it is cited by the value's position.
    """
    kept = docs if excluded is None else docs.join(excluded.select(document), document, "left_anti")
    parts = corpus.partitions(kept, document, text)
    tokens = index.tokens(kept, document, text, ahead=2)
    moves = index.transitions(tokens, document).withColumn("loss", loss).withColumn("entropy", entropy)
    entries = moves.select(F.col(document).alias("row"), F.col("pos").alias("key_offset"), (F.col("pos") + 1).alias("offset"), F.col("next").alias("value"), "loss", "entropy")
    shared = index.shared_ngrams(index.ngrams(tokens, document, 3, 16), document)
    stats = ledger.partition_stats(entries, kept.select(F.col(document).alias("row")))
    return Built(parts, tokens.drop("next1", "next2"), entries, shared, stats, corpus.snapshot(parts))


def located(facts: DataFrame, tokens: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Facts by byte range in token space, and those whose answer does not start and end at tokens.

    facts: (fact, document, start, stop, context) in bytes; tokens: (document, pos, byte, size). The context's token is the
    last that starts at or before it.
    """
    own = facts.join(tokens.select(document, F.col("byte").alias("start"), F.col("pos").alias("first")), [document, "start"])
    own = own.join(tokens.select(document, (F.col("byte") + F.col("size")).alias("stop"), (F.col("pos") + 1).alias("last")), [document, "stop"])
    before = own.join(tokens.select(document, "byte", "pos"), document).where(F.col("byte") <= F.col("context"))
    context = before.groupBy("fact").agg(F.max("pos").alias("context_token"))
    found = own.join(context, "fact", "left").select("fact", document, "first", "last", "context_token")
    return found, facts.join(found.select("fact"), "fact", "left_anti")


def byte_offsets(tokens: DataFrame, document: str, piece: str) -> DataFrame:
    """Where each token's text starts in its document, in UTF-8 bytes."""
    w = Window.partitionBy(document).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(piece)
    return tokens.withColumn("size", size).withColumn("byte", F.coalesce(F.sum(size).over(w), F.lit(0)))
