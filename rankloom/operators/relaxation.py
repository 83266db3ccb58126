"""Relaxation of a search by what it would bring: how many rows each combination of relaxed filters has, from one pass.

A group of clauses has levels from strict to loose; a row passes a level if one of its clauses up to it holds. After the
last level the group may be given up, if it is relaxable. The pass counts rows by the first level that they pass in each
group: a table of as many cells as there are combinations, at most CELLS. Sums along each axis then give the rows of every
choice of levels, and everything else is arithmetic on that table:

guided     step by step: a group that no row at all passes at its level is relaxed first, strong preferences before
           musts and lighter before heavier ones; where all are feasible, the same order decides. Ends at ``target`` rows.
cheapest   the choice of levels with least cost that reaches the target, cost being weight times priority a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import PRIORITY

CELLS = 1 << 16
ORDER = {"strong_prefer": 0, "must": 1}


@dataclass(frozen=True)
class Group:
    """Clauses of one wish, from strict to loose."""

    name: str
    clauses: tuple[Column, ...]
    priority: str = "must"
    weight: float = 1.0
    relaxable: bool = True

    @property
    def loosest(self) -> int:
        return len(self.clauses) if self.relaxable else len(self.clauses) - 1

    def level(self) -> Column:
        """The first level that a row passes; the number of clauses if none. A clause that is null doesn't hold."""
        out = F.lit(len(self.clauses))
        for k, c in reversed(list(enumerate(self.clauses))):
            out = F.when(c, k).otherwise(out)
        return out


@dataclass(frozen=True)
class Choice:
    """Levels by group, rows that pass them, and the steps that led there: (name relaxed, levels, rows)."""

    levels: tuple[int, ...]
    hits: int
    steps: tuple[tuple[str | None, tuple[int, ...], int], ...]


def counts(docs: DataFrame, hard: Column | None, groups: list[Group]) -> np.ndarray:
    """The rows that pass each choice of levels: an array with an axis a group."""
    shape = tuple(len(g.clauses) + 1 for g in groups)
    if np.prod(shape) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of levels")
    base = docs if hard is None else docs.filter(hard)
    cells = np.zeros(shape, np.int64)
    for row in base.groupBy(*(g.level().alias(f"g{k}") for k, g in enumerate(groups))).count().collect():  # a row a cell
        cells[tuple(row[:-1])] = row[-1]
    return reduce(lambda x, axis: x.cumsum(axis), range(len(groups)), cells)


def guided(passing: np.ndarray, groups: list[Group], target: int, most_steps: int = 64) -> Choice:
    full = tuple(n - 1 for n in passing.shape)
    alone = lambda k, level: int(passing[(*full[:k], level, *full[k + 1 :])])
    at = [0] * len(groups)
    steps = [(None, tuple(at), int(passing[tuple(at)]))]
    while steps[-1][2] < target and len(steps) <= most_steps:
        can = [k for k, g in enumerate(groups) if g.priority in ORDER and at[k] < g.loosest]
        if not can:
            break
        empty = [k for k in can if alone(k, at[k]) == 0]
        k = min(empty or can, key=lambda k: (ORDER[groups[k].priority], groups[k].weight, at[k], k))
        at[k] += 1
        steps.append((groups[k].name, tuple(at), int(passing[tuple(at)])))
    best = next((s for s in steps if s[2] >= target), max(steps, key=lambda s: s[2]))
    return Choice(best[1], best[2], tuple(steps))


def cheapest(passing: np.ndarray, groups: list[Group], target: int) -> Choice:
    """Ties: more rows, then smaller levels from the first group on. Where nothing reaches the target, what has most rows."""
    cost = np.zeros(passing.shape)
    allowed = np.ones(passing.shape, bool)
    for k, g in enumerate(groups):
        steps = np.arange(passing.shape[k]).reshape([-1 if j == k else 1 for j in range(passing.ndim)])
        cost = cost + steps * (g.weight * PRIORITY[g.priority])
        allowed &= steps <= g.loosest
    goal = min(target, int(passing[allowed].max()))
    fit = np.argwhere(allowed & (passing >= goal))
    at = min(map(tuple, fit.tolist()), key=lambda x: (round(float(cost[x]), 9), -int(passing[x]), x))
    return Choice(at, int(passing[at]), ((None, at, int(passing[at])),))


def rows(docs: DataFrame, hard: Column | None, groups: list[Group], choice: Choice, tier: str = "tier") -> DataFrame:
    """The rows of a choice, with the step at which each came in."""
    base = docs if hard is None else docs.filter(hard)
    levels = [g.level() for g in groups]
    passed = lambda at: reduce(lambda a, b: a & b, [c <= n for c, n in zip(levels, at)])
    until = next(k for k, s in enumerate(choice.steps) if s[1] == choice.levels)
    step = F.lit(None).cast("int")
    for k in range(until, -1, -1):
        step = F.when(passed(choice.steps[k][1]), k).otherwise(step)
    return base.withColumn(tier, step).filter(F.col(tier).isNotNull())
