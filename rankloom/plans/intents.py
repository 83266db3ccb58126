"""Queries of intents: suppliers' lines stand for what a user asks for, parts for the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import intents
from rankloom.operators.rounds import kept

from .catalogue import table
from .registry import query

FEATURES = (
    intents.Feature("task", "essential.task", "task", 8.0),
    intents.Feature("task_alias", "essential.task_aliases", "task", 8.0 * 0.85, "strong_prefer"),
    intents.Feature("brand", "preferences.brand", "brand", 1.5),
)
CRITERIA = """WITH l AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey), i AS (SELECT s_suppkey AS intent, CASE WHEN s_acctbal < 2000 THEN 'filter' WHEN s_acctbal < 5000 THEN 'relaxable' ELSE 'should' END AS clause, CASE WHEN s_acctbal < 2000 THEN 1.6 WHEN s_acctbal < 5000 THEN 1.3 ELSE 1.0 END AS m, s_nationkey::VARCHAR AS size FROM supplier),
    c AS (SELECT DISTINCT intent, 'task' AS feature, 'task' AS field, p_type AS value, clause, round(8.0 * m, 4)::DOUBLE AS weight FROM i JOIN l ON l_suppkey = intent WHERE l_quantity = 50
        UNION ALL SELECT DISTINCT intent, 'task_alias', 'task', lower(p_type), 'relaxable', 8.84::DOUBLE FROM i JOIN l ON l_suppkey = intent WHERE l_quantity = 50
        UNION ALL SELECT DISTINCT intent, 'brand', 'brand', p_brand, 'should', 1.5::DOUBLE FROM i JOIN l ON l_suppkey = intent WHERE l_quantity = 49
        UNION ALL SELECT DISTINCT intent, 'brand', 'brand', p_brand, 'must_not', 0::DOUBLE FROM i JOIN l ON l_suppkey = intent WHERE l_quantity = 1 AND l_returnflag = 'R'
        UNION ALL SELECT DISTINCT intent, 'functional:' || string_split(p_name, ' ')[1], 'features', string_split(p_name, ' ')[1], 'should', 1::DOUBLE FROM i JOIN l ON l_suppkey = intent WHERE l_quantity = 48
        UNION ALL SELECT intent, 'size', 'size', size, 'should', .5::DOUBLE FROM i)"""


def bundles(spark, d) -> DataFrame:
    """A bundle for each supplier, from the types, brands and names of the parts in its lines."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag").filter("l_quantity >= 48 OR l_quantity = 1").join(table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    of = lambda when, value: F.sort_array(F.collect_set(F.when(F.expr(when), F.expr(value))))
    sets = lines.groupBy("l_suppkey").agg(of("l_quantity = 50", "p_type").alias("types"), of("l_quantity = 49", "p_brand").alias("brands"), of("l_quantity = 1 AND l_returnflag = 'R'", "p_brand").alias("not_brands"), of("l_quantity = 48", "split(p_name, ' ')[0]").alias("items"))
    priority = F.expr("CASE WHEN s_acctbal < 2000 THEN 'must' WHEN s_acctbal < 5000 THEN 'strong_prefer' END")
    pref = lambda include, exclude=None, p=None: F.struct(include.alias("include"), (F.lit(None).cast("array<string>") if exclude is None else exclude).alias("exclude"), (F.lit(None).cast("string") if p is None else p).alias("priority"))
    return table(spark, d, "supplier").join(sets, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").alias("intent"),
        F.struct(pref(F.col("types"), p=priority).alias("task"), pref(F.transform("types", F.lower)).alias("task_aliases")).alias("essential"),
        F.struct(pref(F.col("brands"), F.col("not_brands")).alias("brand")).alias("preferences"),
        F.struct(F.col("items")).alias("functional"),
        F.struct(F.col("s_nationkey").alias("size")).alias("quality"),
    )


def wanted(spark, d) -> DataFrame:
    return intents.criteria(bundles(spark, d), "intent", FEATURES, quality={"size": 0.5})


def values(spark, d) -> DataFrame:
    """(p_partkey, field, value) of every part: its type as it stands and in lower case, brand, words and size."""
    cells = lambda field, c: F.transform(c, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))
    every = F.concat(cells("task", F.array("p_type", F.lower("p_type"))), cells("brand", F.array("p_brand")), cells("features", F.split("p_name", " ")), cells("size", F.array(F.col("p_size").cast("string"))))
    return table(spark, d, "part").select("p_partkey", F.explode(every).alias("c")).select("p_partkey", "c.*")


@query(CRITERIA + " SELECT * FROM c")
def intent_bundle_criteria(spark, d):
    """Bundles as rows of features, clauses and weights."""
    return wanted(spark, d)


VALUES = """, v AS (SELECT DISTINCT * FROM (SELECT p_partkey, 'task' AS field, p_type AS value FROM part UNION ALL SELECT p_partkey, 'task', lower(p_type) FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'features', unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part)),
    b AS (SELECT intent, p_partkey, feature, clause, max(weight) AS weight FROM c JOIN v USING (field, value) GROUP BY ALL)"""
RANKED = """, n AS (SELECT intent, count(DISTINCT feature) FILTER (clause IN ({strict})) AS needed FROM c GROUP BY 1),
    m AS (SELECT intent, p_partkey, round(sum(weight) FILTER (clause <> 'must_not'), 4) AS score, count(*) FILTER (clause NOT IN ('must_not', {strict})) AS n_should FROM b GROUP BY 1, 2 HAVING count(*) FILTER (clause = 'must_not') = 0 AND count(*) FILTER (clause IN ({strict})) = (SELECT needed FROM n WHERE n.intent = b.intent)),
    r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, p_partkey) AS place FROM m WHERE n_should >= {least}) SELECT * FROM r WHERE place <= 10"""


@query(CRITERIA + VALUES + RANKED.format(strict="'filter', 'relaxable'", least=0))
def intent_bundle_ranking(spark, d):
    """The ten best parts of each bundle (a top-k report) under all its filters."""
    return intents.ranked(values(spark, d), kept(wanted(spark, d), "criteria"), "intent", "p_partkey", 10)


@query(CRITERIA + VALUES + RANKED.format(strict="'filter'", least=2))
def intent_bundle_relaxed(spark, d):
    """The same where strong preferences only add to the score and two preferences at least are met."""
    return intents.ranked(values(spark, d), kept(wanted(spark, d), "criteria"), "intent", "p_partkey", 10, True, 2)


@query(CRITERIA + ", k AS (SELECT intent, md5(string_agg(concat_ws('|', feature, field, value, clause, weight), ';' ORDER BY feature, field, value, clause)) AS k FROM c GROUP BY 1) SELECT intent, min(intent) OVER (PARTITION BY k) AS \"class\" FROM k")
def intent_bundle_classes(spark, d):
    """Bundles with the same criteria by the smallest of their ids."""
    return intents.classes(wanted(spark, d), "intent")
