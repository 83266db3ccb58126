"""The rule search against trying every rule, and packed overlaps against sets."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.operators import rule_search
from rankloom.plans import queries as catalogue

SCHEMA = "id int, p array<string>, t1 array<string>, t2 array<string>, extra int"


def fixture(seed, n):
    r = random.Random(seed)
    names = "abcdefgh"
    some = lambda k: r.sample(names, r.randint(0, k))
    rows = [(i, some(5), some(4), some(4), 1) for i in range(n)]
    return [*rows, (n, None, ["a"], ["a"], 1), (n + 1, ["a", "a", None], [], None, 1), (n + 2, [], [], [], 1)]


def clean(x):
    return {w for w in x or [] if w is not None}


def means(rows, removed, added):
    out = []
    for t in (2, 3):
        total = 0.0
        for row in rows:
            p, true = (clean(row[1]) - removed) | added, clean(row[t])
            total += len(p & true) / len(p | true) if p | true else 1.0
        out.append(total / len(rows))
    return out


def goal(m, balance):
    return statistics.mean(m) - balance * statistics.pstdev(m)


def rules(rows, removed, added, balance):
    now = [(clean(r[1]) - removed) | added for r in rows]
    truths = set().union(*(clean(r[2]) | clean(r[3]) for r in rows))
    may = [("remove", f) for f in set().union(*now) - added] + [("add", f) for f in truths - removed if not all(f in p for p in now)]
    return {(k, f): goal(means(rows, removed | ({f} if k == "remove" else set()), added | ({f} if k == "add" else set())), balance) for k, f in may}


@pytest.mark.parametrize("seed, n, balance", [(1, 12, 0.3), (2, 30, 0.0), (3, 5, 1.0)])
def test_search(spark, seed, n, balance):
    rows = fixture(seed, n)
    df = spark.createDataFrame(rows, SCHEMA)
    for removed, added in ((set(), set()), ({"a"}, {"b"}), ({"c", "d"}, set())):
        got = {(r["kind"], r["feature"]): r["objective"] for r in rule_search.scores(df, "p", ["t1", "t2"], balance, sorted(removed), sorted(added)).collect()}
        want = rules(rows, removed, added, balance)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    removed, added, steps, best = set(), set(), [], goal(means(rows, set(), set()), balance)
    while len(steps) < 6:
        each = {k: round(v, 12) for k, v in rules(rows, removed, added, balance).items()}
        top = min(each, key=lambda k: (-each[k], k))
        if each[top] <= round(best, 12):
            break
        best = each[top]
        (removed if top[0] == "remove" else added).add(top[1])
        steps.append(top)
    found = rule_search.search(df, "p", ["t1", "t2"], balance, 6)
    assert [(s["kind"], s["feature"]) for s in found[1:]] == steps
    assert rule_search.search(df.limit(0), "p", ["t1", "t2"], balance) == []


def test_scores_walk_the_cells_once(spark):
    """Rules to add and to remove come from one pass over the rows' features, for any number of truths."""
    rows = [(0, ["a", "b", "b"], ["b", None], ["c"], 1), (1, [], None, [], 1), (2, ["c"], ["c"], ["a", "c"], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for truths in (["t1"], ["t1", "t2"], ["t2", "t1", "t1"]):
        got = rule_search.scores(df, "p", truths, 0.5, ["a"], ["d"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1  # it was two, one for each kind of rule
        assert {(r["kind"], r["feature"]) for r in got.collect()} == {("remove", "b"), ("remove", "c"), ("add", "b"), ("add", "c")} - (set() if "t1" in truths else {("add", "b")})
        for r in got.collect():
            now = [((clean(x[1]) - {"a"}) | {"d"}) - ({r["feature"]} if r["kind"] == "remove" else set()) | ({r["feature"]} if r["kind"] == "add" else set()) for x in rows]
            want = [statistics.mean(len(p & t) / len(p | t) if p | t else 1.0 for p, t in ((p, clean(x[SCHEMA.split(", ").index(f"{name} array<string>")])) for p, x in zip(now, rows))) for name in truths]
            assert r["objective"] == pytest.approx(goal(want, 0.5))


def test_packed(spark):
    rows = fixture(4, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    places = spark.createDataFrame([(c, i * 40) for i, c in enumerate("hgfedcba")], "feature string, place long")
    bits = rule_search.packed(df, "id", {"p": "p", "t1": "t1", "t2": "t2"}, places)
    mask = lambda f: places.filter(F.col("feature") == f).select(F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("mask"))
    got = {r["id"]: (r["t1"], r["t2"]) for r in rule_search.packed_overlaps(bits, "id", "p", ["t1", "t2"], mask("a"), mask("b")).collect()}
    for row in rows:
        p = (clean(row[1]) - {"a"}) | {"b"}
        want = tuple(len(p & clean(t)) / len(p | clean(t)) for t in row[2:4])
        assert got.get(row[0], (0.0, 0.0)) == pytest.approx(want)


def test_packed_in_bounded_tasks(spark, monkeypatch):
    """Tasks get so many cells however many rows there are; rules that share a word count once; a feature of every row meets its place without a shuffle."""
    monkeypatch.setattr(rule_search, "CELLS", 64)
    monkeypatch.setattr(rule_search, "HOT", 0.2)
    r = random.Random(5)
    rows = [(i // 4, i % 4, ["hot", *r.sample("abcdefgh", 4)], r.sample("abcdefgh", 3), ["hot", "hot", None] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "conv int, pos int, p array<string>, t1 array<string>, t2 array<string>")
    places = spark.createDataFrame([(c, i * 30) for i, c in enumerate(["hot", *"abcdefgh"])], "feature string, place long")
    cells = 200 * 8 + 160
    for within in ("conv", None):
        bits = rule_search.packed(df, ["conv", "pos"], {"p": "p", "t1": "t1", "t2": "t2"}, places, within)
        sizes = [n for n in bits.rdd.glom().map(len).collect()]
        assert len(sizes) == cells // 64 + 1 and max(sizes) < 8 * 64
        of = lambda *f: places.filter(F.col("feature").isin(*f)).select(F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("mask"))
        got = {(x["conv"], x["pos"]): (x["t1"], x["t2"]) for x in rule_search.packed_overlaps(bits, ["conv", "pos"], "p", ["t1", "t2"], of("hot", "a", "c"), of("b", "g", "h")).collect()}
        assert len(got) == 200
        for row in rows:
            p = (clean(row[2]) - {"hot", "a", "c"}) | {"b", "g", "h"}
            assert got[row[:2]] == pytest.approx(tuple(len(p & clean(t)) / len(p | clean(t)) for t in row[3:5]))


def test_overlaps_of_turns_that_share_a_number(spark, tmp_path):
    """Two rows of one turn stay two rows, a turn without words has overlaps too, a neighbour is the next row and not the next number."""
    text = [(1, 1, "that avec apple"), (1, 5, "apple that berry"), (1, 9, None), (2, 3, "avec"), (2, 3, "avec"), (None, 1, "berry"), (None, 2, "berry that")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in text], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in catalogue.QUERIES["rule_overlaps_packed"](spark, str(tmp_path)).collect()), key=str)
    third = round(1 / 3, 9)
    want = [(1, 1, 0.0, round(2 / 3, 9)), (1, 5, 0.5, 0.0), (1, 9, third, 0.0), (2, 3, 0.0, 0.0), (2, 3, 0.0, 0.0), (None, 1, 0.0, 1.0), (None, 2, 0.5, 0.0)]
    assert got == sorted(want, key=str)
