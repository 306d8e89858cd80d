"""State kept per session of a stream: what a text has followed so far.

A fold of a session is a step from one state to the next. Streams whose rows are in order from batch to batch are folded as
they come; others wait for the watermark first (`ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.ordered import in_order


def chain_step(state: tuple | None, j: int, entries: list[int], expected: list[bool]) -> tuple[tuple, tuple]:
    """The chains at a position, from those at the last: entries and lengths; and the position with the longest."""
    before = dict(zip(*state, strict=True)) if state else {}
    chains = {int(e): before.get(int(e) - 1, 0) + 1 for e, ok in zip(entries, expected, strict=True) if ok}
    return (list(chains), list(chains.values())), (j, max(chains.values(), default=0))


def request_step(state: tuple | None, at: int, kind: str, live: int) -> tuple[tuple | None, tuple]:
    """A session's version and steps after a request, or None where none is open; and the answer."""
    if kind == "open":
        state = (int(live), 0)
    elif state is not None and kind == "advance":
        state = (state[0], state[1] + 1)
    answer = (at, kind, *(state or (None, None)), "refused" if state is None else "served")
    return None if kind == "close" else state, answer


def chain_lengths(steps: DataFrame, mode: str = "append") -> DataFrame:
    """Per session and position, how long the longest chain of successive entries is: (session, j, length).

    The state is the last position's chains, bounded by the hits of one position; sessions are independent. Rows of a
    session come in order of j from batch to batch; `expected` says for each entry whether the token that came was its value.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("j").itertuples(index=False):
            held, told = chain_step(held, row.j, row.entries, row.expected)
            out.append((key[0], *told))
        yield pd.DataFrame(out, columns=["session", "j", "length"])
        state.update(held)

    return steps.groupBy("session").applyInPandasWithState(run, "session long, j long, length long", "entries array<long>, lengths array<long>", mode, GroupStateTimeout.NoTimeout)


def chain_lengths_late(steps: DataFrame, late: str) -> DataFrame:
    """`chain_lengths` of steps that come up to `late` behind, by their `ts`; of one time in the order of j."""
    step = lambda state, row: chain_step(state, row[1], row[2], row[3])
    found = in_order(steps, "session", "ts", late, {"j": "long", "entries": "array<long>", "expected": "array<boolean>"}, "entries array<long>, lengths array<long>", {"j": "long", "length": "long"}, step)
    return found.withColumnRenamed("key", "session")


def served(requests: DataFrame, mode: str = "append") -> DataFrame:
    """Requests of sessions, answered by the version that each session opened on: (session, at, kind, live).

    `open` pins the version that is live then, `advance` takes a step, `hidden` looks without one, `close` ends; what
    comes to a session that isn't open is refused. Columns: session, at, kind, version, steps, status. The state is a
    session's version and steps; a batch's rows of a session are put in the order of `at`, later batches come later.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, steps = state.get if state.exists else (None, 0)
        held, out = None if version is None else (version, steps), []
        for row in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
            held, told = request_step(held, row.at, row.kind, row.live)
            out.append((key[0], *told))
        yield pd.DataFrame(out, columns=["session", "at", "kind", "version", "steps", "status"]).astype({"version": "Int64", "steps": "Int64"})
        state.update(held or (None, 0))

    return requests.groupBy("session").applyInPandasWithState(run, "session long, at long, kind string, version long, steps long, status string", "version long, steps long", mode, GroupStateTimeout.NoTimeout)


def served_late(requests: DataFrame, late: str, idle: int | None = None) -> DataFrame:
    """`served` for requests that come up to `late` behind, by their `ts`; of one time in the order of `at`.

    A session that is silent for `idle` microseconds is ended with a row of kind and status `expired`, `at` null.
    """
    step = lambda state, row: request_step(state, row[1], row[2], row[3])
    end = lambda state, at: (None, "expired", *state, "expired")
    out = {"at": "long", "kind": "string", "version": "long", "steps": "long", "status": "string"}
    return in_order(requests, "session", "ts", late, {"at": "long", "kind": "string", "live": "long"}, "version long, steps long", out, step, end, idle).withColumnRenamed("key", "session")
