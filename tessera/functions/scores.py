"""Scalar arithmetic of retrieval, citation and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def sim_term(score: Column) -> Column:
    """A cosine of one half counts nothing, of 1 fully."""
    return clamp((score - 0.5) / 0.5, 0, 1)


def confidence(score: Column, support: Column, loss: Column) -> Column:
    """The geometric mean of similarity, support and how well the source is known."""
    product = sim_term(score) * clamp(support, 0, 1) * F.exp(-F.greatest(loss, F.lit(0.0)))
    return F.when(product > 0, F.pow(product, F.lit(1 / 3))).otherwise(0.0)


def trace(length: Column, phrase: int = 24, arc: int = 96) -> Column:
    """How far a chain of this length traces a document: nothing up to a phrase, fully from an arc on."""
    return clamp((length.cast("double") - phrase) / float(arc - phrase), 0, 1)


def gate_floor(floor: float, threads: Column) -> Column:
    """The floor for two sources, lowered as there are more."""
    return F.lit(float(floor)) * 2 / F.greatest(F.lit(2), threads)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 1e-12, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def composite_key(tap: Column, final: Column, alpha: float) -> Column:
    """Two vectors as one of unit length, the first weighing alpha of the square."""
    return F.concat(F.transform(unit(tap), lambda x: x * F.lit(alpha**0.5)), F.transform(unit(final), lambda x: x * F.lit((1 - alpha) ** 0.5)))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Of an array, by its largest value; a temperature of 0 or less means 1."""
    t = float(temperature) if temperature > 0 else 1.0
    top = F.array_max(values)
    parts = F.transform(values, lambda x: F.exp((x - top) / F.lit(t)))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def array_entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def log_softmax_stats(logits: Column, target: Column) -> tuple[Column, Column]:
    """The loss of a target and the entropy of a position's distribution."""
    p = softmax(logits)
    return -F.ln(F.get(p, target)), array_entropy(p)


def cosine_rate(step: Column, steps: int, peak: float, warmup: int, least: float = 0.0) -> Column:
    """A learning rate that warms up linearly and then falls along half a cosine."""
    part = clamp((step - warmup) / F.lit(float(max(1, steps - warmup))), 0, 1)
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(least + (peak - least) * 0.5 * (1 + F.cos(part * 3.141592653589793)))


def stable_rate(step: Column, steps: int, peak: float, warmup: int, decay: int, least: float = 0.0) -> Column:
    """A learning rate that warms up, stays, and falls linearly over the last `decay` steps."""
    left = F.lit(steps) - step
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).when(left > decay, F.lit(peak)).otherwise(least + (peak - least) * clamp(left / float(max(1, decay)), 0, 1))
