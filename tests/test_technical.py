"""Descriptions of READMEs, identifiers and technical phrases on small texts."""

from pyspark.sql import functions as F

from rankloom.functions import technical


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_readme_description(spark):
    of = lambda text, title="Net-2": one(spark, technical.readme_description(F.col("text"), F.col("title")), text=text, title=title)
    body = "---\nlicense: x\n---\n# My net-2\nA <b>net</b>.\n\n```py\nx = 1\n```\n| a | b |\n|--|--|\n## Use\nRun it.\n\nPlease LOGIN first.\n\nUnconditional."
    assert of(body) == "# My net-2\nA net.\n\n## Use\nRun it.\n\nUnconditional."
    assert of("# My net-2\n\nProse.") == of("#My net-2\n\nProse.") == "Prose."
    assert of("You need to agree.\n\nSign-up here.") == "You need to agree.\n\nSign-up here."  # nothing but notices
    assert of("Net-2") == of("") == of(" \n\n ") == ""
    assert of("a\n\nb", None) == "a\n\nb"
    assert of(None) is None
    assert of("long words\n\n" * 20000) == "\n\n".join(["long words"] * 20000)


def test_identifiers(spark):
    of = lambda text: sorted(one(spark, technical.identifiers(F.col("text")), text=text))
    assert of("see my_name ```py\nimport os.path as p\nfoo_bar = fooBar(9abc, été)\nfoo_bar``` and ```ab```") == ["fooBar", "foo_bar", "import", "os.path", "été"]
    assert of("no code") == of("") == of("``` open") == of(None) == []


def test_technical_score(spark):
    of = lambda phrase, names=("load_all",): one(spark, technical.technical_score(F.col("p"), F.array(*map(F.lit, names)), ("cache",)), p=phrase)
    assert [of(p) for p in ("garden", "Cache hit", "ROC AUC", "ÉROC", "a-b", "camelCase", "os.path", "x2", "load_all", "call load_all now", "éa_b")] == [0, 1, 2, 0, 2, 2, 2, 4, 5, 4, 2]
    assert of(None) is None
    assert one(spark, technical.bare(F.col("p")), p=' "(a  \n b).” ') == "a b"
    worth = lambda p: one(spark, technical.worth_scoring(F.col("p"), ("the", "of"), ("the data",)), p=p)
    assert [worth(p) for p in ("ab", "the of it", "the data", "The cat", "x" * 81, "the")] == [False, False, False, True, False, False]
