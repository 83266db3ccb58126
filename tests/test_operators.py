"""Edge cases of the catalogue operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import dedupe, evaluation, quality, ranking, records
from rankloom.sources import files
from rankloom.streaming import events


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (X.normal_text, "Text_Generation", "text generation"),
        (X.normal_text, "Y", "true"),
        (X.normal_text, "org__model.json", "org/model"),
        (X.value_key, "License:MIT", "mit"),
        (X.token_signature, "Llama-3.1 (8B)", "llama 3 1 8b"),
        (X.markdown_to_text, "# A [b](http://c) `d` **e**\n```\ncode\n```", "A b d e"),
        (X.html_to_text, "<p>a &lt; b</p><script>x</script><!-- c -->", "a < b"),
        (X.anonymised, "see `x` at https://a.b/c or me@x.org", "see <CODE> at <URL> or <EMAIL>"),
        (X.without_repeats, "the The cat cat sat", "the cat sat"),
        (X.json_body, 'Sure: ```json\n{"a": 1}\n``` done', '{"a": 1}'),
        (X.json_body, "none", None),
        (X.normal_text, None, None),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_phrase_needs_boundaries(spark):
    df = spark.createDataFrame([("uses gpt-2 here", "GPT-2"), ("uses gpt-22", "gpt-2"), ("c++ code", "c++")], "t string, p string")
    assert [r[0] for r in df.select(X.has_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, True]


def test_row_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 2), (0, 1, 2), (None, 2, None), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(quality.row_mode([F.col(c) for c in "abc"])).collect()] == [1, -1, 2, None]


def test_fuzzy_scores(spark):
    df = spark.createDataFrame([("m", 2), ("m", 2), ("m", 0), ("n", 1), ("n", None)], "k string, v int")
    got = {r["k"]: r for r in quality.fuzzy_scores(df, ["k"], F.col("v")).collect()}
    assert got["m"]["fuzzy_score"] == 0.667 and got["m"]["eligible"]
    assert got["n"]["fuzzy_score"] is None and not got["n"]["eligible"]


def test_rank_counts_a_value_once(spark):
    df = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", ["b"]), (3, None, None)], "model_id int, task string, features array<string>")
    c = [ranking.Criterion("a", ("features",), (("a", 1.0), ("b", 0.5)), 2.0)]
    assert [(r["model_id"], r["score"], r["display_score"]) for r in ranking.rank(df, c).collect()] == [(1, 2.0, 100.0), (2, 1.0, 50.0)]


def test_relax_stops_at_the_target(spark):
    df = spark.range(100)
    stage, counts = ranking.relax(df, [("all", F.lit(True))], [("a", F.col("id") < 5), ("b", F.col("id") < 50)], 40)
    assert stage == 1 and [c["hits"] for c in counts] == [5, 50, 100]


def test_mcnemar(spark):
    df = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)], "a boolean, b boolean")
    r = evaluation.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (r["n10"], r["n01"], r["p_value"]) == (8, 2, 0.109375)


def test_merge_and_membership(spark):
    a, b = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int"), spark.createDataFrame([(2, "c"), (3, None)], "k int, x string")
    assert sorted(map(tuple, dedupe.merged_right_wins(a, b, "k").collect())) == [(1, "a", 1), (2, "c", 2), (3, None, None)]
    assert sorted(map(tuple, dedupe.membership(a, b, "k").collect())) == [(1, "left"), (2, "both"), (3, "right")]


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.json").write_text(json.dumps({"id": "a", "n": {"x": 1}}))
    (tmp_path / "in/sub/b.json").write_text(json.dumps([{"id": "b"}, {"id": "c"}]))
    (tmp_path / "in/broken.json").write_text("{oops")
    (tmp_path / "in/other.txt").write_text("no")
    docs = files.json_documents(spark, str(tmp_path / "in"), "id string, n struct<x:int>")
    assert sorted(r["id"] for r in docs.collect()) == ["a", "b", "c"]
    assert files.flattened(docs).columns == ["id", "n.x"]
    (tmp_path / "r.json").write_text(json.dumps({"k1": {"v": 1}, "k2": {"v": None}}))
    assert sorted(map(tuple, files.json_records(spark, str(tmp_path / "r.json"), "v int").collect())) == [("k1", 1), ("k2", None)]
    (tmp_path / "c.csv").write_text("a;b\n1;x\nbad\n2;y\n")
    assert len(files.separated(spark, str(tmp_path / "c.csv"), "a int, b string").collect()) >= 2
    files.write_json(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_streaming_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.write.parquet(str(tmp_path / "e"))
    live = events.tumbling(spark.readStream.schema(src.schema).parquet(str(tmp_path / "e")), "1 day")
    q = live.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("tumbled")) == key(events.tumbling(spark.read.parquet(str(tmp_path / "e")), "1 day"))


def test_quotas():
    from rankloom.operators.sampling import quotas

    got = quotas({"a": 1000, "b": 50, "c": 3}, 100, 10)
    assert sum(got.values()) == 100 and got["c"] == 3 and got["b"] >= 10 and got["a"] > got["b"]
    assert quotas({"a": 2, "b": 1}, 10, 5) == {"a": 2, "b": 1} and quotas({}, 10, 5) == {}


def test_one_to_one_alignment_against_loop(spark):
    from rankloom.operators.alignment import aligned

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def like(a, b):
        if min(len(a), len(b)) >= 3 and (a in b or b in a):
            return 1.0
        return 1 - distance(a, b) / max(len(a), len(b), 1)

    def loop(p, t):
        left = sorted((-like(x, y), i, j) for i, x in enumerate(p) for j, y in enumerate(t) if like(x, y) >= 0.5)
        out = []
        for _, i, j in left:
            if all(i != a and j != b for a, b in out):
                out.append((i, j))
        return out

    cases = [(["cat", "bat", "rat"], ["rat", "cats", "hat"]), ([], ["x"]), (["x"], []), (["same", "same"], ["same"]), (["speed", "speech", "spree"], ["spec", "seed", "tree", "spree"]), (["", "a"], ["", "a"])]
    rows = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(cases)], "k int, p array<string>, t array<string>").select("k", aligned("p", "t").alias("got")).collect()
    for r in rows:
        assert [tuple(x) for x in r.got] == loop(*cases[r.k])


def test_one_edit_apart_of_long_words(spark):
    """Words about and above the length from which ends stand for forms, each with every kind of edit at every place."""
    from rankloom.operators.alignment import one_edit_apart

    word = "".join(chr(97 + i * i % 23) for i in range(43))
    a = {word[:n] for n in (38, 39, 40, 41, 42, 43)} | {"a" * 5000, "a" * 5002}
    b = {x for w in a if len(w) < 50 for i in range(len(w)) for x in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + "z" + w[i:])} | {"a" * 4999, "a" * 5001, word[1:] + "b", word[::-1]}

    def near(x, y):  # what is between the common start and the common end
        i = next((k for k, (c, e) in enumerate(zip(x, y)) if c != e), min(len(x), len(y)))
        j = next((k for k, (c, e) in enumerate(zip(x[i:][::-1], y[i:][::-1])) if c != e), min(len(x), len(y)) - i)
        return max(len(x), len(y)) - i - j <= 1

    frame = lambda x: spark.createDataFrame([(w,) for w in sorted(x)], "v string")
    want = {(x, y) for x in a for y in b if near(x, y)}
    assert {tuple(r) for r in one_edit_apart(frame(a), frame(b)).collect()} == want and len(want) > 700


def test_one_edit_apart_against_loop(spark):
    from rankloom.operators.alignment import one_edit_apart

    a, b = ["abc", "abcd", "xyz", "", "aab"], ["abd", "abc", "bcd", "ab", "yz", "aaab"]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "v string")
    got = {tuple(r) for r in one_edit_apart(frame(a), frame(b)).collect()}
    assert got == {("abc", "abd"), ("abc", "abc"), ("abc", "ab"), ("abcd", "abd"), ("abcd", "abc"), ("abcd", "bcd"), ("xyz", "yz"), ("aab", "ab"), ("aab", "aaab")}


def test_names_fan_out_by_bundles(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none"), (4, None), (5, "a")], "row int, name string")
    names = spark.createDataFrame([("a", i) for i in range(7)] + [("a", None), ("b", 3), ("other", 9), (None, 8)], "name string, id int")
    out = records.fanned(rows, names, "name", "id", 2)
    want = [(r, "a", i) for r in (1, 5) for i in (*range(7), None)] + [(2, "b", 3), (3, "none", None), (4, None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_a_fan_out_of_one_name_is_small_and_shared_out(spark, tmp_path):
    """Every row meets every id of a name; files hold a small part of a byte for each, and more than one task writes them."""
    rows = spark.range(3000).select(F.col("id").alias("row"), F.lit("a").alias("name")).union(spark.createDataFrame([(-1, "none"), (-2, None)], "row long, name string"))
    names = spark.range(3000).select(F.lit("a").alias("name"), F.format_string("id %d of a", "id").alias("id"))
    out = records.fanned(rows.coalesce(1), names, "name", "id", 1000)
    out.write.parquet(f"{tmp_path}/out")
    files = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < 3000 * 3000 * 0.4 and sum(n > 10_000 for n in files) > 2
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.filter("row >= 0").agg(F.count("id"), F.sum("row"), F.count_distinct("id")).first() == (9_000_000, 3000 * 4_498_500, 3000)
    assert got.filter("row >= 0").groupBy("row").agg(F.count_distinct("id").alias("n")).filter("n <> 3000").count() == 0
    assert sorted(map(tuple, got.filter("row < 0").collect())) == [(-2, None, None), (-1, "none", None)]


def test_casefold_counts_ids_once(spark):
    """Ids that repeat, in several forms, count once; rows without an id count as rows only."""
    rows = spark.createDataFrame([("Abc", 1), ("ABC", 1), ("abc", 1), ("abc", 2), ("abc", None), (None, 3), ("x", None)], "p string, id int")
    got = {r["key"]: tuple(r)[1:] for r in dedupe.casefold_merged(rows, "p", "id").collect()}
    assert got == {"abc": ("Abc", 5, 2), None: (None, 1, 1), "x": ("x", 1, 0)}


def test_an_index_of_words_is_shuffled_once(spark):
    from rankloom.plans.queries import QUERIES

    plan = QUERIES["inverted_index_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
