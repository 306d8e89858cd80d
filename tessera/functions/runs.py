"""Longest common runs of many pairs of sequences at once, by ranks of runs whose lengths double."""

from __future__ import annotations

import numpy as np


def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs of ranks."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1] if len(left) else left


def shared(rank: np.ndarray, pair: np.ndarray, second: np.ndarray, number: int) -> np.ndarray:
    """For each pair whether some rank occurs on both of its sides."""
    key = np.unique(pair * (rank.max(initial=0) + 1) + rank, return_inverse=True)[1] if len(rank) else rank
    sides = np.zeros((2, int(key.max(initial=-1)) + 1), bool)
    sides[second.astype(int), key] = True
    found = np.zeros(number, bool)
    found[pair[sides.all(0)[key]]] = True
    return found


def longest_common(tokens: np.ndarray, pair: np.ndarray, second: np.ndarray, left: np.ndarray, number: int) -> np.ndarray:
    """The most tokens in a row that both sides of each pair have.

    tokens: numbers of all pairs' tokens, each side's in a row; pair and second: the pair and the side of each; left: how many
    tokens of its side there are from it on. Ranks tell runs of 1, 2, 4, ... tokens apart. The longest such length that a
    pair shares grows by the shorter ones, longest first; the work is that of sorting the tokens once for each length.
    """
    best = np.zeros(number, np.int64)
    levels, rank, at = [], tokens.astype(np.int64), np.arange(len(tokens))
    whole = np.full(len(tokens), -1)
    while len(at):  # runs of 2 ** len(levels) tokens at the positions `at`, of the pairs that still share one
        alive = shared(rank, pair[at], second[at], number)
        best[alive] = 1 << len(levels)
        keep = alive[pair[at]]
        table = whole.copy()
        table[at[keep]] = rank[keep]
        levels.append(table)
        reach = 1 << (len(levels) - 1)
        at = at[keep]
        at = at[left[at] >= 2 * reach]
        at = at[table[at + reach] >= 0]
        rank = ranked(table[at], table[at + reach])
    now = whole.copy()
    length = best[pair]
    for k, table in enumerate(levels):
        own = length == 1 << k
        now[own] = table[own]
    for k in range(len(levels) - 2, -1, -1):
        step, length = 1 << k, best[pair]
        at = np.flatnonzero((now >= 0) & (length > step) & (left >= length + step))
        # A rank says what it is among runs of its pair's length; those of other lengths are told apart by the pair.
        following = levels[k][at + length[at]]
        at, following = at[following >= 0], following[following >= 0]
        rank = ranked(now[at], following)
        grown = shared(rank, pair[at], second[at], number)
        mine = grown[pair[at]]
        now[grown[pair]] = -1
        now[at[mine]] = rank[mine]
        best[grown] += step
    return best
