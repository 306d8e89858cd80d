"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A side of a join without equal keys that is small by its nature: broadcast if it has no more than `most` rows.

    Where it has more, it is left as it is, and both sides meet partition by partition: the same rows, by another plan.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
