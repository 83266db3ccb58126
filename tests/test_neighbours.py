"""Neighbours against all pairs, and the recall of few probes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import neighbours

SF = "/root/testdata/sf0.01"


def fixture():
    r = random.Random(5)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 0.4) for m in r.choice(middles)], i % 3) for i in range(150)]
    rows += [(i, rows[7][1], 0) for i in (200, 201, 202)]  # ties
    return rows + [(300, None, 0), (301, [0.0] * 6, 0), (302, [1.0] * 5, 0), (303, [1.0] * 5 + [None], 0), (304, [float("nan")] * 6, 0), (305, [1e-3] * 6, 0)]


def scores(rows, dims=6):
    unit = {}
    for i, v, _ in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    return {a: sorted(((-round(float(unit[a] @ unit[b]), 6) + 0.0, b) for b in unit if b != a)) for a in unit}


@pytest.mark.parametrize("slot, questions, probes, k", [(4096, 1024, 2, 5), (7, 3, 1, 500)])
def test_search(spark, monkeypatch, slot, questions, probes, k):
    monkeypatch.setattr(neighbours, "SLOT", slot)
    monkeypatch.setattr(neighbours, "QUERIES", questions)
    rows = fixture()
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    centres = neighbours.train(df, "id", "v")
    assert centres.shape[1] == 6 and 10 <= len(centres) <= 13
    found = neighbours.index(df, centres, "id", "v", ("g",))
    all_ = scores(rows)
    assert {r["id"] for r in found.rows.collect()} == set(all_)
    got = {}
    for r in neighbours.search(found, df, "id", "v", k, probes).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"] + 0.0, r["id"])
    assert {q: [x[n] for n in sorted(x)] for q, x in got.items()} == {q: x[:k] for q, x in all_.items()}
    some = scores([r for r in rows if r[2] == 1])
    near = neighbours.search(found.where(F.col("g") == 1), df.filter("g = 1"), "id", "v", k, probes).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in near) == sorted((q, n + 1, i) for q, x in some.items() for n, (_, i) in enumerate(x[:k]))
    near = neighbours.within(found, df, "id", "v", 0.8).collect()
    assert sorted((r["query_id"], r["id"]) for r in near) == sorted((q, i) for q, x in all_.items() for s, i in x if -s >= 0.8)


def test_few_are_found_in_other_cells(spark):
    """Without exact, queries whose cells hold fewer than k look further."""
    df = spark.createDataFrame(fixture(), "id long, v array<double>, g int")
    found = neighbours.index(df, neighbours.train(df, "id", "v", 30), "id", "v")
    n = neighbours.search(found, df.filter("id < 20"), "id", "v", 40, 1, exact=False).groupBy("query_id").count().collect()
    assert {r["count"] for r in n} == {40} and len(n) == 20


def test_recall(spark):
    """At least 0.9 of the ten nearest, against all rows, for other queries than those that the number of probes is taken from."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = neighbours.index(v, neighbours.train(v, "vec_id", "embedding"), "vec_id", "embedding")
    probes = neighbours.probes_for(found, v.filter("vec_id % 10 = 5"), "vec_id", "embedding", goal=0.95)
    queries = v.filter("vec_id % 10 = 0")
    exact, some = (neighbours.search(found, queries, "vec_id", "embedding", probes=probes, exact=x) for x in (True, False))
    assert exact.count() == 10 * queries.count() and neighbours.recall(some, exact) >= 0.9


def test_few_probes_where_there_are_groups(spark):
    df = spark.createDataFrame([r for r in fixture() if r[0] < 200], "id long, v array<double>, g int")
    found = neighbours.index(df, neighbours.train(df, "id", "v"), "id", "v")
    assert neighbours.probes_for(found, df, "id", "v", 3, 0.9, 60) <= len(found.centres) // 2


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, v array<double>")
    centres = neighbours.train(df, "id", "v")
    assert len(centres) == 0
    found = neighbours.index(df, np.zeros((0, 3)), "id", "v")
    assert neighbours.search(found, df, "id", "v").collect() == []


def test_nearest_rounded_is_exact_over_slots(spark, monkeypatch):
    """Ties by the rounded cosine go to the smaller id, copies and zero vectors included; no row is compared in an expression a pair."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)] + [(90, [0.0] * 4), (91, None), (92, [1.0, None, 0.0, 0.0]), (93, [1.0, 0.0])]
    monkeypatch.setattr(neighbours, "SLOT", 17)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    df = spark.createDataFrame(rows, "vec int, e array<float>")
    got = sorted(map(tuple, neighbours.nearest_rounded(df, df.filter("vec % 10 = 0"), "vec", "e", 7, 2).collect()))
    whole = {i: np.array(e) for i, e in rows[:91]}
    cos = lambda a, b: round(float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-30), 2) + 0.0
    want = [(q, *x) for q in range(0, 91, 10) for x in [(i, -c, n + 1) for n, (c, i) in enumerate(sorted((-cos(whole[q], e), i) for i, e in whole.items() if i != q)[:7])]]
    assert got == sorted((q, i, c + 0.0, n) for q, i, c, n in want)
