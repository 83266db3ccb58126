"""Quotas against loops on numbers."""

import random

import pytest

from rankloom.operators import sampling


def moved(share, amount, limit, weight, sign):
    while amount > 1e-9:
        room = {c: max(0.0, (limit[c] - share[c]) * sign) for c in share}
        may = [c for c in share if room[c] > 1e-12]
        if not may or sum(room.values()) <= 1e-9:
            break
        give, whole = min(amount, sum(room.values())), sum(weight[c] for c in may)
        steps = {c: min(give * (weight[c] / whole if whole else 1 / len(may)), room[c]) for c in may}
        for c, x in steps.items():
            share[c] += sign * x
        amount -= sum(steps.values())


def rebalanced(n, total, least, ideal):
    total = min(total, sum(n.values()))
    low, want = ({c: float(min(k, n[c])) for c in n} for k in (least, ideal))
    share = {c: max(k * total / sum(n.values()), low[c]) for c, k in n.items()}
    moved(share, sum(share.values()) - total, low, dict(share), -1)
    amount = min(sum(max(0.0, want[c] - share[c]) for c in n), sum(max(0.0, share[c] - want[c]) for c in n))
    up, down, was = {c: max(want[c], share[c]) for c in n}, {c: min(want[c], share[c]) for c in n}, dict(share)
    moved(share, amount, down, was, -1)
    moved(share, amount, up, n, 1)
    lack = sum(max(0.0, share[c] - n[c]) for c in n) + max(0.0, total - sum(share.values()))
    share = {c: min(share[c], n[c]) for c in n}
    moved(share, lack, n, n, 1)
    out = {c: int(x + 1e-9) for c, x in share.items()}
    for c in sorted(n, key=lambda c: (-round(share[c] - out[c], 9), c))[: total - sum(out.values())]:
        out[c] += 1
    return out


@pytest.mark.parametrize("seed, classes, total, least, ideal", [(1, 6, 100, 10, 20), (2, 40, 500, 5, 12), (3, 5, 10_000, 3, 9), (4, 9, 60, 0, 30)])
def test_rebalanced(spark, seed, classes, total, least, ideal):
    r = random.Random(seed)
    n = {f"c{k:02}": int(10 ** r.uniform(0, 3)) for k in range(classes)}
    df = spark.createDataFrame(list(n.items()), "class string, n long")
    got = {x["class"]: x["quota"] for x in sampling.rebalanced(df, total, least, ideal).collect()}
    assert got == rebalanced(n, total, least, ideal) and sum(got.values()) == min(total, sum(n.values()))
    assert {x["class"]: x["quota"] for x in sampling.quota_table(df, total, least).collect()} == sampling.quotas(n, total, least)


def test_samples_of_many_classes(spark):
    """More classes than any list on the driver would like, a null class, nothing twice."""
    df = spark.range(6000).selectExpr("id", "case when id % 7 = 0 then null else cast(id % 1500 as string) end as c")
    got = sampling.quota_sample(df, "c", "id", 3000, 1).collect()
    n, have = {}, {}
    for r in df.collect():
        n[r["c"]] = n.get(r["c"], 0) + 1
    for r in got:
        have[r["c"]] = have.get(r["c"], 0) + 1
    assert len({r["id"] for r in got}) == len(got) == 3000
    assert have.keys() == n.keys() and all(have[c] <= n[c] for c in n)
    assert sampling.rebalanced_sample(df.limit(0), "c", "id", 10, 1, 2).collect() == []


def test_points_of_a_grid(spark):
    df = spark.createDataFrame([(a, b) for a in ("x", "y", "z", None) for b in (3, 1, 2, 7)], "a string, b int")
    every = [(r["a"], r["b"]) for r in sampling.grid_points(df, ["a", "b"], 100, 5).orderBy("nth").collect()]
    assert sorted(every) == sorted((a, b) for a in "xyz" for b in (1, 2, 3, 7))  # each once, however many are asked for
    assert [(r["a"], r["b"]) for r in sampling.grid_points(df, ["a", "b"], 4, 5).orderBy("nth").collect()] == every[:4]
    some = sampling.random_points(df, ["a", "b"], 30, 1).collect()
    assert len({(r["a"], r["b"]) for r in some}) == len(some) <= 12 and {(r["a"], r["b"]) for r in some} <= set(every)
    assert sampling.grid_points(df.limit(0), ["a", "b"], 3).collect() == [] == sampling.random_points(df.limit(0), ["a", "b"], 3).collect()
