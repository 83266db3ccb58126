"""Measures on small lists."""

import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluation


def test_average_precision(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("b", 2, True), ("c", 1, False), ("d", 5, True)]
    got = {r["g"]: (r["n"], r["n_relevant"], r["ap"]) for r in evaluation.average_precision(spark.createDataFrame(rows, "g string, k int, hit boolean"), ["g"], [F.col("k")], F.col("hit")).collect()}
    assert got == {"a": (3, 2, (1 + 2 / 3) / 2), "b": (2, 1, 0.5), "c": (1, 0, None), "d": (1, 1, 1.0)}


def test_importance(spark):
    rows = [("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 3.0), ("y", 2, 4.5), (None, 2, 3.0), ("x", 1, None)]
    got = {r["parameter"]: r for r in evaluation.importance(spark.createDataFrame(rows, "p string, q int, m double"), ["p", "q"], "m").collect()}
    values = [r[2] for r in rows if r[2] is not None]
    total, mean = statistics.pvariance(values) * len(values), statistics.mean(values)
    for k, name in enumerate("pq"):
        levels = {}
        for r in rows:
            if r[2] is not None:
                levels.setdefault(r[k], []).append(r[2])
        assert got[name]["levels"] == len(levels)
        assert got[name]["importance"] == pytest.approx(sum(len(x) * (statistics.mean(x) - mean) ** 2 for x in levels.values()) / total)
    same = evaluation.importance(spark.createDataFrame([("x", 1.0), ("y", 1.0)], "p string, m double"), ["p"], "m").first()
    assert (same["effect"], same["importance"]) == (0.0, 0.0)
