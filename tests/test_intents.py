"""Intents as criteria and the rows they find, against a loop over plain dictionaries."""

import random
from itertools import product

from rankloom.operators import intents

PREF = "struct<include:array<string>,exclude:array<string>,priority:string>"
SCHEMA = f"intent long, essential struct<task:{PREF},domain:{PREF}>, preferences struct<language:{PREF},last_modified:struct<include:array<string>>>, functional struct<items:array<string>>, quality struct<speed:int>"


def test_criteria(spark):
    rows = [
        (1, {"task": (["a", "a", " ", None], ["b"], "must"), "domain": (["d"], None, "odd")}, {"language": (None, ["xx"], None), "last_modified": (["2024"],)}, (["f", "g"],), (4,)),
        (2, {"task": (["a"], None, "avoid"), "domain": None}, None, None, (None,)),
        (3, None, None, (None,), None),
        (None, {"task": (["z"], None, "strong_prefer"), "domain": None}, None, None, None),
    ]
    got = intents.criteria(spark.createDataFrame(rows, SCHEMA), "intent", quality={"speed": 0.5, "absent": 1.0}).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            (1, "task", "task", "a", "filter", 12.8),
            (1, "task", "task", "b", "must_not", 0.0),
            (1, "domain", "domain", "d", "should", 2.0),
            (1, "language", "language", "xx", "must_not", 0.0),
            (1, "last_modified", "last_modified_year", "2024", "filter", 0.0),
            (1, "functional:f", "features", "f", "should", 1.0),
            (1, "functional:g", "features", "g", "should", 1.0),
            (1, "speed", "speed", "4", "should", 0.5),
            (2, "task", "task", "a", "must_not", 0.0),
            (None, "task", "task", "z", "relaxable", 10.4),
        ],
        key=str,
    )
    assert intents.criteria(spark.createDataFrame([(1,)], "intent long"), "intent").count() == 0


def test_matches_and_classes(spark):
    rng = random.Random(2)
    held = {(row, "f", str(rng.randrange(6))) for row, _ in product(range(40), range(3))} | {(row, "g", "hot") for row in range(40)}
    asked = [(i, f"x{rng.randrange(3)}", "f", str(rng.randrange(6)), rng.choice(("filter", "relaxable", "should", "must_not")), float(rng.randrange(4))) for i in range(25) for _ in range(3)]
    asked = sorted(set(asked)) + [(30, "h", "g", "hot", "should", 1.0), (31, "h", "g", "hot", "should", 1.0), (32, "h", "g", "none", "filter", 1.0)]
    values = spark.createDataFrame(sorted(held) + [(1, "f", None), (0, "g", "hot")], "row long, field string, value string")
    wanted = spark.createDataFrame(asked, "intent long, feature string, field string, value string, clause string, weight double")
    for relaxed, least in product((False, True), (0, 2)):
        strict = {"filter"} if relaxed else {"filter", "relaxable"}
        want = set()
        for i, row in product({x[0] for x in asked}, range(40)):
            mine = [x for x in asked if x[0] == i]
            hit = {}
            for _, feature, field, value, clause, weight in mine:
                if (row, field, value) in held:
                    hit[feature, clause] = max(weight, hit.get((feature, clause), 0))
            must = {x[1] for x in mine if x[4] in strict}
            n_should = sum(c not in strict and c != "must_not" for _, c in hit)
            passed = len({(f, c) for f, c in hit if c in strict})
            if hit and not any(c == "must_not" for _, c in hit) and passed == len(must) and n_should >= least:
                want.add((i, row, round(sum(hit.values()), 4), n_should))
        found = intents.matches(values, wanted, "intent", "row", relaxed, least)
        assert {tuple(r) for r in found.collect()} == want and want
        top = {tuple(r)[:2] for r in intents.best(found, "intent", "row", 2).collect()}
        assert top == {x[:2] for i in {x[0] for x in want} for x in sorted((x for x in want if x[0] == i), key=lambda x: (-x[2], x[1]))[:2]}
    same = {r["intent"]: r["class"] for r in intents.classes(wanted, "intent").collect()}
    assert same[31] == same[30] == 30 and same[32] == 32
    assert intents.matches(values.limit(0), wanted, "intent", "row").count() == 0


def test_ranked_meets_each_class_and_profile_once(spark, monkeypatch):
    """The k best as by all pairs, copies of intents and rows and several blocks included; copies are matched once."""
    rng = random.Random(5)
    held = [(row, "f", str(v)) for row in range(12) for v in rng.sample(range(6), 3)] + [(row, "g", f"alone{row}") for row in range(12)]
    held += [(row + 12 * c, f, v) for row, f, v in held for c in range(1, 5)]
    asked = [(i, f"x{j}", "f", str(rng.randrange(6)), rng.choice(("filter", "should", "should", "must_not", "relaxable")), float(rng.randrange(4))) for i in range(9) for j in range(3)]
    asked += [(i + 9 * c, *x) for i, *x in asked for c in range(1, 4)]
    values = spark.createDataFrame(held, "row long, field string, value string")
    wanted = spark.createDataFrame(asked + [(None, "x0", "f", "1", "should", 1.0)], "intent long, feature string, field string, value string, clause string, weight double")
    monkeypatch.setattr(intents, "BLOCK", 10)
    whole, seen = intents.matches, []
    for relaxed, least, k in ((False, 0, 3), (True, 1, 7)):
        want = intents.best(whole(values, wanted, "intent", "row", relaxed, least), "intent", "row", k).collect()
        monkeypatch.setattr(intents, "matches", lambda v, w, *more: (seen.append((v.select("row").distinct().count(), w.select("intent").distinct().count())), whole(v, w, *more))[1])
        got = intents.ranked(values, wanted, "intent", "row", k, relaxed, least).collect()
        monkeypatch.setattr(intents, "matches", whole)
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    assert all(rows <= 12 and ids <= 9 for rows, ids in seen) and seen


def test_only_the_best_leave_a_slot(spark, monkeypatch):
    """Features that look into several fields, rows that hold several values of one, and ties, in slots of any size: of each slot at
    most k rows of an intent go on, and the k best of all are the loop's."""
    rng = random.Random(8)
    held = {(row, f, str(rng.randrange(5))) for row in range(60) for f in "fgh" for _ in range(rng.randrange(1, 4))}
    asked = sorted({(i, f"x{rng.randrange(3)}", rng.choice("fgh"), str(rng.randrange(6)), rng.choice(("filter", "should", "should", "relaxable")), rng.randrange(1, 40) / 10) for i in range(30) for _ in range(6)})
    asked += sorted({(i, "no", "f", str(rng.randrange(5)), "must_not", 0.0) for i in range(0, 30, 3)})
    values = spark.createDataFrame(sorted(held), "row long, field string, value string")
    wanted = spark.createDataFrame(asked, "intent long, feature string, field string, value string, clause string, weight double")
    want = {}
    for i, row in product(range(30), range(60)):
        mine, hit = [x for x in asked if x[0] == i], {}
        for _, feature, field, value, clause, weight in mine:
            if (row, field, value) in held:
                hit[feature, clause] = max(weight, hit.get((feature, clause), 0))
        n_should = sum(c in ("should", "relaxable") for _, c in hit)
        if hit and ("no", "must_not") not in hit and sum(c == "filter" for _, c in hit) == len({x[1] for x in mine if x[4] == "filter"}) and n_should >= 1:
            want.setdefault(i, []).append((-round(sum(hit.values()), 4), row, n_should))
    assert sum(len(x) > 12 for x in want.values()) > 5
    for block, rows in ((4, 7), (1000, 1000)):
        monkeypatch.setattr(intents, "BLOCK", block)
        monkeypatch.setattr(intents, "ROWS", rows)
        found = [tuple(r) for r in intents.matches(values, wanted, "intent", "row", True, 1, 3).collect()]
        assert len(found) <= 3 * len(want) * -(-60 // rows)
        for i, of_i in want.items():
            best = sorted((-score, row, n) for x, row, score, n in found if x == i)[:3]
            assert best == sorted(of_i)[:3]
    assert len(intents.matches(values, wanted, "intent", "row", True, 1).collect()) == sum(map(len, want.values()))


def test_more_intents_are_no_more_tables_to_hold(spark, monkeypatch):
    """What tasks are given doesn't grow with the number of slots: no plan has a broadcast for each."""
    values = spark.createDataFrame([(row, "f", str(row % 5)) for row in range(20)], "row long, field string, value string")
    wanted = spark.createDataFrame([(i, "x", "f", str(i % 7), "should", 1.0) for i in range(60)], "intent long, feature string, field string, value string, clause string, weight double")
    monkeypatch.setattr(intents, "BLOCK", 6)
    found = intents.matches(values, wanted, "intent", "row")
    assert found._jdf.queryExecution().executedPlan().toString().count("Broadcast") < 4
    assert found.count() == sum(i % 7 == row % 5 for i in range(60) for row in range(20))
