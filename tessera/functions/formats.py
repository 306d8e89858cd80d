"""Ids, addresses, fingerprints and readable forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import sha256


def source_id(document: Column, partition: Column) -> Column:
    return F.concat_ws("#", document, partition.cast("string"))


def parsed_source_id(identifier: Column) -> Column:
    """Document and partition of a source id; the last mark parts them. Null where there is no number."""
    index = F.substring_index(identifier, "#", -1)
    sound = identifier.rlike("#[0-9]+$")
    return F.struct(F.when(sound, F.substring(identifier, F.lit(1), F.length(identifier) - F.length(index) - 1)).alias("document_id"), F.when(sound, index).cast("int").alias("partition_index"))


def address(own: Column, caller: Column, document: Column, partition: Column, offset: Column) -> Column:
    """Where a token was cited from; a row's own thread id goes before the caller's."""
    return F.struct(F.coalesce(own, caller).alias("thread"), document.alias("document_id"), partition.alias("partition_index"), offset.alias("offset"))


def generation_id(manifest: Column, prompt: Column, params: Column) -> Column:
    return F.substring(sha256(F.concat_ws("|", manifest, prompt, params)), 1, 16)


def fingerprint(settings: list[Column]) -> Column:
    """Eight digits of settings as JSON with the defaults, which are null, left out."""
    return F.substring(sha256(F.to_json(F.struct(*settings), {"ignoreNullFields": "true"})), 1, 8)


def run_id(preset: Column, moment: Column) -> Column:
    return F.concat(F.date_format(moment, "yyyyMMdd-HHmmss"), F.lit("-"), preset)


def whole_second(moment: Column) -> Column:
    return F.date_trunc("second", moment)


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours, the largest two units."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m")))
    )


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def remaining(done: Column, steps: Column, seconds: Column, evaluations: Column, cost: Column) -> Column:
    """Seconds still to go at the rate so far, with the evaluations to come."""
    return F.when(done > 0, (steps - done) * seconds / done + evaluations * cost)


def node_list(text: str) -> list[str]:
    """`a, b, c` as names; empty, repeated and ill-formed ones are errors."""
    names = [n.strip() for n in text.split(",")]
    if not all(re.fullmatch(r"[a-z0-9][a-z0-9._-]{1,63}", n) for n in names) or len(set(names)) < len(names):
        raise ValueError(f"not a list of different names: {text}")
    return names


def source_policy(text: str) -> tuple[str, object]:
    """`all`, `spans`, `fact`, `top:N` or explicit ids."""
    if text in ("all", "spans", "fact"):
        return text, None
    if m := re.fullmatch(r"top:([1-9][0-9]*)", text):
        return "top", int(m[1])
    ids = [x for x in text.split(",") if x]
    if not ids:
        raise ValueError("no sources named")
    return "ids", ids
