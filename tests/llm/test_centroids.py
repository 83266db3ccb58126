"""Operator 13 against Lloyd's rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rankloom.llm import centroids


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("g" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, of) if j == n] for n in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else c[n] for n, g in enumerate(groups)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in last if j == n) for n in range(len(c))]
    return sorted(((i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def vectors(seed, n, spread):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [float(np.float32(m + r.gauss(0, spread))) for m in r.choice(middles)]) for i in range(n)]


ODD = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [1.0] * 63 + [float("nan")]), (6, [float("-inf")] + [1.0] * 63), (7, [1.0] * 65)]
TABLES = {
    "groups": vectors(1, 300, 0.3) + ODD,
    "ties": [(i, [float(i % 3)] + [0.0] * 63) for i in range(60)] + [(3, [0.5] * 64), (3, [0.25] * 64), (None, [0.5] * 64), (None, [-0.0] * 64)],
    "equal": [(i, [0.5] * 64) for i in range(40)],
    "few": vectors(2, 5, 1.0),
    "none": ODD,
}


@pytest.mark.parametrize("name", TABLES)
def test_clusters(spark, name):
    rows = TABLES[name]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = centroids.clustered(docs)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("largest", [3, 1000, centroids.LARGEST])
def test_screen_is_exact(largest):
    """Also where float32 can't tell the centroids apart."""
    r = np.random.default_rng(largest)
    x = r.integers(-largest, largest + 1, (500, 64))
    c = np.concatenate([r.integers(-largest, largest + 1, (5, 64)), x[:2], x[:2] + np.eye(64, dtype=np.int64)[0], x[:1]])
    got, unsure = centroids.nearest(x, c)
    exact = [min((sum(int(a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c.tolist()))[1] for v in x.tolist()]
    assert got.tolist() == exact and unsure >= 1
    far = np.concatenate([x[:100], x[:100] + 0])
    got, unsure = centroids.nearest(far, np.stack([np.full(64, -largest), np.full(64, largest)]))
    assert got.tolist()[:100] == got.tolist()[100:]


def test_too_large(spark):
    with pytest.raises(Exception, match="131072"):
        centroids.clustered(spark.createDataFrame([(1, [2e5] * 64)], "vec_id long, embedding array<float>")).collect()
