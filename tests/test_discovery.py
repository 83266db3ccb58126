"""Relaxation, trios and open JSON against plain loops."""

import json
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.functions import open_json as J
from rankloom.operators import relaxation, trios


@pytest.fixture(scope="module")
def numbers(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, r.randrange(10), r.randrange(10), r.choice([None, 1, 2, 3])) for i in range(200)], "id int, a int, b int, c int")


def groups():
    return [
        relaxation.Group("a", (F.col("a") > 20, F.col("a") > 7), "must", 2.0),
        relaxation.Group("b", (F.col("b") == 1, F.col("b") < 4, F.col("b") < 6), "strong_prefer", 1.0, relaxable=False),
        relaxation.Group("c", (F.col("c") == 3,), "prefer", 1.0),
    ]


def passes(row, at):
    clauses = [[row["a"] > 20, row["a"] > 7, True], [row["b"] == 1, row["b"] < 4, row["b"] < 6, True], [row["c"] == 3, True]]
    return all(any(c[: n + 1]) for c, n in zip(clauses, at))


def test_counts_of_all_combinations(numbers):
    got, rows = relaxation.counts(numbers, F.col("id") >= 10, groups()), numbers.filter("id >= 10").collect()
    for at in product(range(3), range(4), range(2)):
        assert got[at] == sum(passes(r, at) for r in rows)
    with pytest.raises(ValueError):
        relaxation.counts(numbers, None, [relaxation.Group(str(k), (F.lit(True),) * 7) for k in range(6)])


@pytest.mark.parametrize("target", [0, 1, 5, 20, 1000])
def test_guided_and_cheapest(numbers, target):
    g = groups()
    n = relaxation.counts(numbers, None, g)
    choice = relaxation.guided(n, g, target)
    names = [s[0] for s in choice.steps]
    assert names[0] is None and (target == 0 or names[1] == "a")  # no row has a > 20, so a goes first though b is the weaker wish
    assert choice.hits >= target or choice.levels[:2] == (2, 2)
    rows = relaxation.rows(numbers, None, g, choice).collect()
    assert len(rows) == choice.hits
    for r in rows:
        assert r["tier"] == next(k for k, s in enumerate(choice.steps) if passes(r, s[1]))
    cheap = relaxation.cheapest(n, g, target)
    cost = lambda at: at[0] * 3.2 + at[1] * 1.3 + at[2] * 1.0
    may = [at for at in product(range(3), range(3), range(2))]
    goal = min(target, max(n[at] for at in may))
    assert cheap.levels == min((at for at in may if n[at] >= goal), key=lambda at: (round(cost(at), 9), -n[at], at))


@pytest.mark.parametrize("top", [2, 64])
def test_trios(spark, monkeypatch, top):
    monkeypatch.setattr(trios, "TOP", top)
    r = random.Random(top)
    rows = [(i, r.choice("xyz"), r.choice("pqrs"), r.randrange(6), r.sample("abcdefgh", r.randint(0, 4))) for i in range(70)]
    rows += [(100, None, "p", 9, ["a"]), (101, "x", "p", None, ["a"]), (102, "x", None, 9, ["a"]), (103, "x", "p", 9, None), (104, "x", "p", 9, [None, "q", "q"]), (200, "w", "p", 1, ["a"]), (201, "w", "q", 1, ["a"])]
    got = {x["grp"]: (x["score"], x["ids"]) for x in trios.best_trios(spark.createDataFrame(rows, "id long, grp string, maker string, likes int, features array<string>"), 0.4).collect()}
    want = {}
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0
    for three in combinations([x for x in rows if None not in x[1:4]], 3):
        if len({x[1] for x in three}) == 1 and len({x[2] for x in three}) == 3:
            f = [{w for w in x[4] or [] if w} for x in three]
            if sum(share(a, b) > 0.4 for a, b in combinations(f, 2)) >= 2:
                found = (-sum(x[3] for x in three), sorted(x[0] for x in three))
                want[three[0][1]] = min(want.get(three[0][1], found), found)
    assert got == {k: (-s, ids) for k, (s, ids) in want.items()} and len(want) == 3


DOCS = [
    '{"a": {"b": [1, 2, {"c": "x"}], "e": {}, "0": true}, "n": null, "t": "é\\"q"}', '[1, 2, "three"]', '[[1], {"k": 2.5}, "s"]', '"alone"', "7", "{broken", None, "{}", "[]", '{"l": [[], [[{"z": 1}]]]}', "null",
]


def flat(x, path=""):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(x, list):
        path = path or "__root__"
        if not any(isinstance(v, (dict, list)) for v in x):
            return [(path, json.dumps(x, separators=(",", ":"), ensure_ascii=False))]
        return [y for i, v in enumerate(x) for y in flat(v, f"{path}[{i}]")]
    return [(path, x if x is None or isinstance(x, str) else json.dumps(x))]


def test_leaves(spark):
    got = J.leaves(spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string"), "id", "doc").collect()
    want = [(i, p, v) for i, d in enumerate(DOCS) if d is not None and d != "{broken" for p, v in flat(json.loads(d))]
    assert sorted(((r["id"], r["path"], r["value"]) for r in got), key=str) == sorted(want, key=str)
    kinds = {(r["id"], r["path"]): r["kind"] for r in got}
    assert kinds[0, "n"] == "VOID" and kinds[0, "a.0"] == "BOOLEAN" and kinds[8, "__root__"] == "ARRAY"
    assert J.leaves(spark.createDataFrame([], "id int, doc string"), "id", "doc").collect() == []


def test_paths_and_guards(spark):
    v = spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string").select("id", J.parsed("doc").alias("v")).orderBy("id")
    one = v.select(J.at("v", "a.b.2.c", "string").alias("x"), J.at("v", "a.0", "boolean").alias("y"), J.at("v", "a.b.0", "int").alias("z"), J.at("v", "a.b.9.c", "string").alias("w")).first()
    assert tuple(one) == ("x", True, 1, None)
    assert [r[0] for r in v.select(J.only_strings(F.col("v"))).collect()] == [None] * 8 + [[]] + [None] * 2
    assert [r[0] is not None for r in v.select(J.only_list(F.col("v"))).collect()] == [False, True, True, False, False, False, False, False, True, False, False]
    assert v.select(F.to_json(J.only_keys(F.col("v"), ["n", "t", "missing"]))).first()[0] == '{"n":null,"t":"é\\"q"}'
    assert v.select(J.with_keys(F.col("v"), ["t", "missing"])).first()[0] == '{"t":"é\\"q","missing":null}'
    assert {(r["key"], r["n"]) for r in J.key_counts(spark.createDataFrame([(d,) for d in DOCS], "doc string"), "doc").collect()} == {("a", 1), ("n", 1), ("t", 1), ("l", 1)}
    wide = J.keys_to_columns(spark.createDataFrame([(1, '{"k": 3, "s": "q"}'), (2, "[]")], "id int, doc string"), "id", "doc", ["k", "s"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, "3", "q"), (2, None, None)]


def test_wrapped(spark):
    kind = StructType.fromDDL("a int, b struct<c: string, d: array<int>>, e array<struct<f: int>>")
    df = spark.createDataFrame([((1, ("x", [1, 2]), [(3,), (None,)]),), ((None, None, None),)], StructType().add("s", kind))
    got = [r[0] for r in df.select(J.wrapped("s", kind)).collect()]
    assert got[0] == ([1], (["x"], [1, 2]), [([3],), (None,)]) and got[1] == (None, None, None)
