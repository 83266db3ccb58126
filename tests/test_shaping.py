"""Names, phrases, places, families and files against small cases worked out by hand or by brute force."""

import difflib
import json
import random

from pyspark.sql import functions as F

from rankloom.functions import phrases
from rankloom.operators import families, likeness, ranks
from rankloom.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_names_and_phrases(spark):
    family, size, tuning = phrases.name_parts(F.lit("FooBar-7b-chat"))
    assert one(spark, family, size, tuning) == ("foo bar", 7, "chat")
    assert one(spark, phrases.canonical_phrase(F.lit("The NLP_image-models")), phrases.compact_phrase(F.lit("x: a (b) / c models"))) == ("NLP image model", "a c")
    assert one(spark, phrases.chunks(F.array(*map(F.lit, ("aaa", "bb", "", "cccccccc", "d"))), 6, " ")) == (["aaa bb", "cccccccc", "d"],)
    assert one(spark, phrases.first_seen(F.split(F.lit("B a b A c"), " ")), phrases.list_cell(F.lit("['x', \"y\"]")), phrases.list_cell(F.lit("x; y"))) == (["B", "a", "c"], ["x", "y"], ["x", "y"])
    assert one(spark, phrases.one_alternative(F.lit("a {z|b} c (_)")), phrases.grade(F.lit("grade: 0.8")), phrases.grade(F.lit("7 of 9")), phrases.grade(F.lit("none"))) == ("a b c", 8.0, 7.0, None)
    assert one(spark, phrases.expansion(F.split(F.lit("we use natural language processing here"), " "), F.lit("NLP")), phrases.expansion(F.split(F.lit("a b"), " "), F.lit("XY"))) == ("natural language processing", None)
    assert one(spark, phrases.clean_url(F.lit("HTTP://A.b/C/?q#x")), phrases.shared_stem(F.array(F.lit("model")), F.array(F.lit("models")))) == ("http://a.b/C", True)


def test_places(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *map(float, range(30))]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    for parts in (1, 7):
        got = [r["i"] for r in ranks.ranked(df, "v", ["i"], "nth", parts).orderBy("nth").collect()]
        assert got == sorted(range(500), key=lambda i: (values[i] is not None, values[i] or 0, i))
        some = sorted(v for v in values if v is not None)
        mean = {v: some.index(v) + 1 + (some.count(v) - 1) / 2 for v in set(some)}
        assert {(r["v"], r["r"]) for r in ranks.average_ranks(df, "v", "r", parts).collect()} == {(None, None), *mean.items()}
        assert {r["share"]: r["value"] for r in ranks.at_shares(df, "v", [0.0, 0.5, 1.0], parts).collect()} == {s: some[round(s * (len(some) - 1))] for s in (0.0, 0.5, 1.0)}


def test_likeness(spark):
    rng = random.Random(2)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    sizes = [12] * 200 + [400] * 12
    for n in sizes:
        a, b = ("".join(rng.choice("abc ") if n < 100 else rng.choice("abcdefghijklmnopqrstuvwxyz   eeeee") for _ in range(rng.randrange(n))) for _ in "xy")
        if n > 100:
            b = b + a[: len(a) // 2] + b[:50]  # long common blocks, and the rule of frequent characters
        assert likeness.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
        assert abs(likeness.indel(a, b) - (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12
    assert likeness.ratio("x" * 300, "x" * 300) == difflib.SequenceMatcher(None, "x" * 300, "x" * 300).ratio()
    assert likeness.token_sort("b a", "a b") == 1.0 and likeness.token_set("a b c", "c a") == 1.0 and likeness.token_set("", "a") == 0.0
    assert likeness.partial("abc", "xxabcxx") == 1.0 and likeness.partial("", "a") == 0.0 and likeness.partial_tokens("a q", "z q y") == 1.0
    assert likeness.weighted("", "a") == 0.0 and likeness.weighted("ab cd", "cd ab") == 0.95 and likeness.weighted("abc", "xxabcxx") == 0.9
    asked = [("A b", "a  b"), ("colour image models", "color image models"), ("NLP", "NLQ"), ("deep net", "net deep"), ("image model", "large image model here"), ("abc", "xyz"), ("", "a"), ("neural nets (NN)", "nn")]
    assert [likeness.cascade(*p)[0] for p in asked] == ["exact", "alike", "none", "conservative", "contained", "none", "none", "exact"]
    pairs = spark.createDataFrame([("a", "a"), (None, "b")], "x string, y string")
    assert [(r["ratio"], r["reason"], r["score"]) for r in likeness.compared(pairs, "x", "y").collect()] == [(1.0, "exact", 1.0), (0.0, "none", 0.0)]
    assert likeness.greedy_pairs(["ab", "abc"], ["abc", "abd"], 0.5) == [(0, 0), (1, 1)]


def test_families(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "child string, parent string")
    assert {(r["leaf"], tuple(r["path"])) for r in families.root_paths(edges).collect()} == {("c", ("a", "b", "c")), ("d", ("a", "d"))}
    df = spark.createDataFrame([(1, None, "x"), (2, 1, None), (3, 2, None), (4, 3, None)], "id long, base long, f string")
    assert {(r["id"], r["f"], r["hop"]) for r in families.inherited(df, "id", "base", "f").collect()} == {(1, "x", 0), (2, "x", 1), (3, "x", 2), (4, None, None)}
    scores = spark.createDataFrame([(1, "a", 0.5, 0.0, False), (1, "b", 0.5, 0.0, True), (2, "a", 0.9, 0.0, False), (2, "b", 0.1, 0.0, True)], "k long, candidate string, score double, boost double, tagged boolean")
    assert {(r["k"], r["candidate"]) for r in families.assigned(scores, "k", 0.03, 0.08).collect()} == {(1, "b"), (2, "a")}
    order = families.feasible_order([("a", None, 1, "must", 1.0), ("b", None, 0, "must", 9.0), ("c", None, 1, "strong_prefer", 5.0)])
    assert [x[0] for x in order] == ["b", "c", "a"]


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "j/b.json").write_text(json.dumps({"x": 3}))
    docs = files.with_ids(files.json_documents(spark, f"file://{tmp_path}/j"))
    assert {(r["_id"], r["x"]) for r in docs.collect()} == {("a.json#0", 1), ("a.json#1", 2), ("b.json#0", 3)}
    (tmp_path / "q.csv").write_text('a;b\n1;say "x\n2;y\n3\n')
    assert [tuple(r) for r in files.separated_robust(spark, f"file://{tmp_path}/q.csv").collect()] == [("1", 'say "x'), ("2", "y")]
    (tmp_path / "t.csv").write_text("k,s,\n,p,r\n1,2,3\n")
    two = files.two_level(spark, f"file://{tmp_path}/t.csv")
    assert two.columns == ["k", "s__p", "s__r"] and [tuple(r) for r in two.collect()] == [("1", "2", "3")]
    (tmp_path / "i.tsv").write_text("Id\tName\nfra\tFrench\ndeu\t\n")
    assert [tuple(r) for r in files.tab_table(spark, f"file://{tmp_path}/i.tsv").collect()] == [("fra", "French"), ("deu", None)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/c.yaml").write_text("name: 'foo'\nsub:\n  x: 1\nsize: 7\n")
    (tmp_path / "m/d.json").write_text('{"name": "bar"}')
    assert {tuple(r) for r in files.key_values(spark, f"file://{tmp_path}/m").collect()} == {("c.yaml", "name", "foo"), ("c.yaml", "size", "7"), ("d.json", "name", "bar")}
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    files.routed(docs, spark.createDataFrame([(1,), (1,)], "id long"), "id", f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert [spark.read.json(f"file://{tmp_path}/{x}").first()["id"] for x in ("in", "out")] == [1, 2]
    files.updated(docs, spark.createDataFrame([(2, "z", 5)], "id long, v string, w long"), "id", f"file://{tmp_path}/new")
    assert {(r["id"], r["v"], r["w"]) for r in spark.read.json(f"file://{tmp_path}/new").collect()} == {(1, "a", None), (2, "z", 5)}
    files.write_separated(docs.withColumn("l", F.array(F.lit("x"), F.lit("y"))), f"file://{tmp_path}/csv", ";")
    assert {tuple(r) for r in spark.read.option("header", True).option("sep", ";").csv(f"file://{tmp_path}/csv").collect()} == {("1", "a", "x | y"), ("2", "b", "x | y")}
