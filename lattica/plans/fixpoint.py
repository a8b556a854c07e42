"""The only place where algorithms run jobs: rounds of a plan until it settles."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from lattica.store import cut


@dataclass
class Stats:
    """A row per round: number, rows of the state, seconds."""

    rounds: list[tuple[int, int, float]] = field(default_factory=list)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[dict], bool], name: str, max_rounds: int = 10_000, measures: dict[str, Column] | None = None, stats: Stats | None = None) -> DataFrame:
    """Apply step until done(measures of the new state) or max_rounds.

    Each round is one job that writes the new state to the shared folder and measures it on the way.
    """
    for k in range(1, max_rounds + 1):
        begun = time.time()
        state, seen = cut(step(state, k), name, **(measures or {}))
        if stats:
            stats.rounds.append((k, seen["n"], time.time() - begun))
        if done(seen):
            break
    return state
