"""Queries of measures and of what stands around or above a hit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import evaluation

from .catalogue import CATALOGUE, catalogue, table
from .registry import query


@query("""WITH r AS (SELECT l_orderkey, (l_returnflag = 'R')::INT AS hit, row_number() OVER w AS k, sum((l_returnflag = 'R')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber))
    SELECT l_orderkey, count(*) AS n, sum(hit)::BIGINT AS n_relevant, round(coalesce(sum(hit * s / k) / nullif(sum(hit), 0), -1), 9) AS ap FROM r GROUP BY 1""")
def eval_average_precision(spark, d):
    """Of each order's lines by price: how early the returned ones come. -1 where none was returned."""
    lines = table(spark, d, "lineitem")
    got = evaluation.average_precision(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], F.col("l_returnflag") == "R")
    return got.withColumn("ap", F.round(F.coalesce("ap", F.lit(-1.0)), 9))


@query("""WITH l AS (SELECT 'returnflag' AS parameter, l_returnflag AS level, l_discount::DOUBLE AS x FROM lineitem UNION ALL SELECT 'linestatus', l_linestatus, l_discount::DOUBLE FROM lineitem UNION ALL SELECT 'linenumber', l_linenumber::VARCHAR, l_discount::DOUBLE FROM lineitem),
    m AS (SELECT parameter, level, count(*) AS n, avg(x) AS m FROM l GROUP BY 1, 2), w AS (SELECT parameter, var_pop(x) * count(*) AS total, avg(x) AS mean FROM l GROUP BY 1)
    SELECT parameter, count(*) AS levels, round(max(m) - min(m), 6) AS effect, round(sum(n * (m - mean) ** 2) / any_value(total), 6) AS importance FROM m JOIN w USING (parameter) GROUP BY 1""")
def eval_parameter_importance(spark, d):
    """How much of the discounts' variance lies between the levels of three parameters."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_linenumber").alias("linenumber"), "l_discount")
    got = evaluation.importance(lines, ["returnflag", "linestatus", "linenumber"], "l_discount")
    return got.select("parameter", "levels", F.round("effect", 6).alias("effect"), F.round("importance", 6).alias("importance"))


CLAUSES = {"economy": "task = 'ECONOMY'", "ring": "list_contains(features, 'ring')", "liked": "likes > 33", "small_brand": "author = 'Brand#1' AND p_size < 5"}


@query(f"""WITH {CATALOGUE}, h AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS clause, model_id, likes FROM catalogue WHERE {c}" for k, c in CLAUSES.items()) + """)
    SELECT clause, model_id, likes, n, rank::INT AS rank FROM (SELECT *, count(*) OVER (PARTITION BY clause) AS n, row_number() OVER (PARTITION BY clause ORDER BY likes DESC, model_id) AS rank FROM h) WHERE rank <= 2""")
def clause_top_hits(spark, d):
    """Of each clause its hits and the two most liked: one pass, combined before the shuffle."""
    c = {"economy": F.col("task") == "ECONOMY", "ring": F.array_contains("features", "ring"), "liked": F.col("likes") > 33, "small_brand": (F.col("author") == "Brand#1") & (F.col("p_size") < 5)}
    hits = catalogue(spark, d).select("model_id", "likes", F.explode(F.filter(F.array(*(F.when(x, F.lit(k)) for k, x in c.items())), lambda x: x.isNotNull())).alias("clause"))
    n = hits.groupBy("clause").agg(F.count(F.lit(1)).alias("n"))
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("clause").orderBy(F.desc("likes"), "model_id"))).filter("rank <= 2")
    return top.join(n, "clause").select("clause", "model_id", "likes", "n", "rank")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
    SELECT doc_id, i::INT AS line, array_to_string(l[greatest(i - 2, 1):i + 2], ' / ') AS context FROM p WHERE contains(l[i], '@')""")
def context_windows(spark, d):
    """Each line with an at sign between its two neighbours on either side."""
    l = F.split("text", "\n", -1)  # noqa: E741
    lines = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", l.alias("l"))
    hits = F.filter(F.transform("l", lambda x, i: F.when(F.contains(x, F.lit("@")), i + 1)), lambda i: i.isNotNull())
    around = F.transform(hits, lambda i: F.struct(i.alias("line"), F.array_join(F.slice("l", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)) + 2), " / ").alias("context")))
    return lines.select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.line", "x.context")
