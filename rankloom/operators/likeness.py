"""Likeness of short strings, in Arrow batches over distinct pairs: Spark has no function for it.

ratio        twice the characters of matching blocks by the lengths of both. The longest block first (the earliest of equal ones),
             then the same on either side of it. In a second string of 200 characters or more, characters that make up
             more than one in a hundred of it begin no block, but a block grows over them: a known rule of such ratios, kept
             so that scores agree with it
indel        twice the longest common subsequence by both lengths
token_sort, token_set, partial, weighted: indel over sorted words, over shared and other words, over the best stretch, and the
             usual mix of them by how far lengths differ
cascade      exact, alike, then, unless an acronym is among them, the conservative mix; at last containment
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_WORDS_SHORT = 2
#: From this length on the characters of the second string with a share of over 1 % begin no block.
LONG, POPULAR = 200, 100


class _Blocks:
    """Matching blocks of two strings. Runs that end at a character of a are counted along b, a row at a time."""

    def __init__(self, a: str, b: str):
        codes = {x: k for k, x in enumerate(dict.fromkeys(a + b))}
        self.a, self.b = (np.array([codes[x] for x in t], np.int64) for t in (a, b))
        n = np.bincount(self.b, minlength=len(codes) or 1)
        self.begins = n[self.b] <= len(b) // POPULAR + 1 if len(b) >= LONG else np.ones(len(b), bool)

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        b, begins = self.b[b0:b1], self.begins[b0:b1]
        run = np.zeros(len(b) + 1, np.int64)
        i, j, size = a0, b0, 0
        for k in range(a0, a1):
            same = (b == self.a[k]) & begins
            run[1:] = np.where(same, run[:-1] + 1, 0)
            top = int(run.max())
            if top > size:
                size = top
                i, j = k + 1 - size, b0 + int(run.argmax()) - size
        while i > a0 and j > b0 and self.a[i - 1] == self.b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and self.a[i + size] == self.b[j + size]:
            size += 1
        return i, j, size

    def matched(self) -> int:
        total, todo = 0, [(0, len(self.a), 0, len(self.b))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            if a0 < a1 and b0 < b1:
                i, j, size = self.longest(a0, a1, b0, b1)
                if size:
                    total += size
                    todo += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
        return total


def ratio(a: str, b: str) -> float:
    return 2 * _Blocks(a, b).matched() / (len(a) + len(b)) if a or b else 1.0


def indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 1 for two empty strings."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of shared words against each side, and of both sides with the shared words first; 0 where a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel(one, other), indel(both, one) if both else 0.0, indel(both, other) if both else 0.0)


def partial(a: str, b: str) -> float:
    """The best indel of the shorter string with a stretch of the longer one, of its length or cut off at an end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    stretches = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(indel(a, s) for s in stretches)


def partial_tokens(a: str, b: str) -> float:
    """1 if a word is shared; else partial over sorted words."""
    return 1.0 if set(a.split()) & set(b.split()) else partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted(a: str, b: str) -> float:
    """Of strings of like length the whole or 0.95 of the words' likeness; of others also 0.9 (0.6 beyond eight times) of the partial ones."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    if by < 1.5:
        return max(indel(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if by <= 8 else 0.6
    return max(indel(a, b), scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


def threshold(a: str, b: str) -> float:
    """Short phrases must be closer than long ones."""
    return 0.9 if min(len(a.split()), len(b.split())) <= MOST_WORDS_SHORT else 0.8


def conservative(phrase: str, base: float) -> float:
    """The least score by the phrase's letters and digits: base up to 12, at most 0.89 up to 20, at most 0.88 beyond."""
    n = sum(c.isalnum() for c in phrase)
    return base if n <= 12 else min(base, 0.89 if n <= 20 else 0.88)


def plain(phrase: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", phrase.lower()).split())


def is_acronym(phrase: str) -> bool:
    """One short word of capitals and digits."""
    return re.fullmatch(r"[A-Z][A-Z0-9]{1,7}", phrase.strip()) is not None


def variants(phrase: str) -> list[str]:
    """The phrase without its brackets, and what each bracket holds."""
    inside = [x.strip() for x in re.findall(r"\(([^()]*)\)", phrase) if x.strip()]
    outside = re.sub(r"\([^()]*\)", " ", phrase).strip()
    return list(dict.fromkeys([x for x in (outside, *inside) if x])) or [phrase]


#: Reasons from strong to weak.
REASONS = ("exact", "alike", "conservative", "contained", "none")


def cascade(a: str, b: str, base: float = 0.9, contained: int | None = 5) -> tuple[str, float]:
    """(why two phrases are one or "none", score 0 to 1): the strongest reason of a's variants, then the highest score. contained: the
    fewest characters of one that the other holds; None: containment is no reason."""
    best = ("none", 0.0)
    for v in variants(a):
        x, y = plain(v), plain(b)
        found = ("none", 0.0)
        if x and y:
            s = ratio(x, y)
            if x == y:
                found = ("exact", 1.0)
            elif s >= base:
                found = ("alike", s)
            elif not (is_acronym(v) or is_acronym(b)):
                n = max(sum(c.isalnum() for c in t) for t in (v, b))
                t = weighted(x, y) if n <= 12 else indel(x, y)
                found = ("conservative", t) if t >= round(conservative(v, base), 2) else ("none", max(s, t))
            if found[0] == "none" and contained is not None and min(len(x), len(y)) >= contained and (x in y or y in x):
                found = ("contained", found[1])
        best = min(best, found, key=lambda r: (REASONS.index(r[0]), -r[1]))
    return best


def compared(pairs: DataFrame, a: str, b: str, base: float = 0.9, contained: int | None = 5) -> DataFrame:
    """pairs with ratio, indel, weighted, reason and score of columns a and b; nulls compare as empty strings."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x or "", y or "") for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            known = {r: (ratio(*r), indel(*r), weighted(*r), *cascade(*r, base, contained)) for r in set(rows)}
            new = [pa.array([known[r][k] for r in rows], pa.string() if k == 3 else pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "ratio", "indel", "weighted", "reason", "score"])

    return pairs.mapInArrow(run, f"{fields}, ratio double, indel double, weighted double, reason string, score double")


def greedy_pairs(left: list[str], right: list[str], least: float) -> list[tuple[int, int]]:
    """Each of left in turn takes the best unused of right at ``least`` or more; ties to the first."""
    free, out = dict(enumerate(right)), []
    for i, x in enumerate(left):
        best = max(free, key=lambda j: (ratio(x, free[j]), -j), default=None)
        if best is not None and ratio(x, free[best]) >= least:
            out.append((i, best))
            del free[best]
    return out
