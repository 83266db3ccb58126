"""The best three records of a group that hang together: of different makers, two of their three pairs sharing enough features, with most likes.

Two pairs of three always share a record, so a trio is a record with two partners. For each record only the best partner
of each other maker can matter, and of those the best two: no triple is ever listed. Pairs come from an equality join on
group and feature, behind a bound: the best trio among each group's TOP most liked records is a score that every better trio has to
reach, so a record whose likes and the group's two highest don't reach it is out, and so is a pair whose likes and the
group's highest don't. Equal scores go to the smallest ids.

Records with a null group, maker, likes or id take no part; null features are dropped, repeated ones count once. Records without
features share nothing. Groups without such a trio have no row. Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import kept

TOP = 64


def _pairs(nodes: DataFrame, least: float, floor: Column) -> DataFrame:
    """(a, b records as structs) of one group and different makers whose features overlap by more than least (shared by the smaller list)."""
    who = F.struct("likes", "id", "maker", F.size("features").alias("n")).alias("x")
    each = nodes.select("grp", "bound", "top1", who, F.explode("features").alias("feature"))
    l, r = each.alias("l"), each.alias("r")  # noqa: E741
    on = (F.col("l.grp") == F.col("r.grp")) & (F.col("l.feature") == F.col("r.feature")) & (F.col("l.x.id") < F.col("r.x.id")) & (F.col("l.x.maker") != F.col("r.x.maker"))
    met = l.join(r, on & floor).groupBy(F.col("l.grp").alias("grp"), F.col("l.x").alias("a"), F.col("r.x").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return met.filter(F.col("shared") / F.least("a.n", "b.n") > least).select("grp", "a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """(grp, score, ids): the best trio of each group."""
    both = pairs.union(pairs.select("grp", "b", "a")).toDF("grp", "a", "b")
    rank = F.struct(F.col("b.likes").alias("likes"), (-F.col("b.id")).alias("minus"))
    partner = both.groupBy("grp", "a", F.col("b.maker").alias("maker")).agg(F.max(rank).alias("p"))
    w = Window.partitionBy("grp", "a").orderBy(F.desc("p"))
    two = partner.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("grp", "a").agg(F.count(F.lit(1)).alias("k"), F.sum("p.likes").alias("likes"), F.collect_list(-F.col("p.minus")).alias("ids"))
    trio = two.filter("k = 2").select("grp", (F.col("likes") + F.col("a.likes")).alias("score"), F.array_sort(F.array_append("ids", F.col("a.id"))).alias("ids"))
    return trio.groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ids")).alias("t")).select("grp", (-F.col("t.minus")).alias("score"), "t.ids")


def best_trios(records: DataFrame, least: float = 0.1) -> DataFrame:
    """records (id, grp, maker, likes, features) -> (grp, score, ids): of each group the best trio, ids ascending."""
    features = F.array_distinct(F.filter("features", lambda x: x.isNotNull()))
    nodes = records.dropna(subset=["id", "grp", "maker", "likes"]).select("id", "grp", "maker", "likes", F.coalesce(features, F.array().cast("array<string>")).alias("features"))
    nodes = kept(nodes, "records")
    first = nodes.select("grp", "likes", "id").withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("likes"), "id"))).filter(F.col("k") <= TOP)
    tops = kept(first.groupBy("grp").agg(F.max(F.when(F.col("k") == 1, F.col("likes"))).alias("top1"), F.max(F.when(F.col("k") == 2, F.col("likes"))).alias("top2")), "tops")
    few = nodes.join(first.select("grp", "id"), ["grp", "id"]).join(tops, "grp").withColumn("bound", F.lit(None).cast("double"))
    reached = kept(_best(_pairs(few, least, F.lit(True))).select("grp", F.col("score").alias("bound")), "reached")
    bounded = nodes.join(tops, "grp").join(reached, "grp", "left")
    hopeful = bounded.filter(F.col("bound").isNull() | (F.col("likes") + F.col("top1") + F.col("top2") >= F.col("bound")))
    return _best(_pairs(hopeful, least, F.col("l.bound").isNull() | (F.col("l.x.likes") + F.col("r.x.likes") + F.col("l.top1") >= F.col("l.bound"))))
