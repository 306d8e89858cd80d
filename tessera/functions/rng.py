"""A seeded 64-bit generator whose numbers are the same everywhere, and what is drawn from it."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public SplitMix64 generator, and the multiplier that parts streams.
GAMMA, MIX_A, MIX_B, STREAM = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03
MASK = (1 << 64) - 1


@dataclass
class SplitMix64:
    state: int

    def next(self) -> int:
        self.state = (self.state + GAMMA) & MASK
        z = self.state
        z = ((z ^ z >> 30) * MIX_A) & MASK
        z = ((z ^ z >> 27) * MIX_B) & MASK
        return z ^ z >> 31

    def below(self, bound: int) -> int:
        return self.next() % bound

    def unit(self) -> float:
        return (self.next() >> 11) * 2.0**-53

    def shuffled(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    @classmethod
    def derived(cls, seed: int, stream: int) -> SplitMix64:
        return cls(cls(seed ^ (stream * STREAM & MASK)).next())


def unit_of(seed: int):
    """A number in [0, 1) for each key: the first of the key's own stream. Seeds are 64-bit, so they stay in Python."""

    @F.pandas_udf(T.DoubleType())
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: SplitMix64.derived(seed, int(k) & MASK).unit())

    return run


def shuffle_of(seed: int):
    """An array shuffled by the generator."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: SplitMix64(seed).shuffled(list(a)))

    return run


def rearranged(units: list, seed: int, tries: int = 64) -> list:
    """A shuffle in which no two neighbours were neighbours in that order before, if one is found."""
    random = SplitMix64(seed)
    best = units
    for _ in range(tries):
        order = random.shuffled(list(range(len(units))))
        best = [units[i] for i in order]
        if all(b != a + 1 for a, b in zip(order, order[1:], strict=False)):
            return best
    return best
