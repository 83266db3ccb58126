"""Families from tables: equal records go through the joins once."""

from rankloom.operators import families


def test_equal_records_are_one_class(spark):
    rows = [(i, "K" if i % 2 else None, "red ring" if i % 3 else None, ["a", "b"] if i % 5 else None) for i in range(60)]
    models = spark.createDataFrame(rows, "id long, kind string, name string, tags array<string>")
    hints = spark.createDataFrame([("k", "f1", None, 0.9)], "kind string, family string, child string, confidence double")
    patterns = spark.createDataFrame([("red ring", "f2", "c", 0.8)], "phrase string, family string, child string, confidence double")
    aliases = spark.createDataFrame([("tag", "b", "f3", 0.5)], "field string, word string, family string, weight double")
    got = families.by_tables(models, hints, patterns, aliases)
    want = {i: "f1" if k else "f2" if n else "f3" if t else families.UNCLEAR for i, k, n, t in rows}
    assert {r["id"]: r["family"] for r in got.collect()} == want and got.count() == len(rows)
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for at in [k for k, x in enumerate(lines) if "Generate explode" in x]:  # what is laid out as words has been grouped before
        below = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
        assert any("Aggregate" in x for x in lines[at:below])
    assert any(x.lstrip(" :+-").startswith("Generate") for x in lines)
