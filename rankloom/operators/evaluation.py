"""Measures of rankings, labels and sets."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(df: DataFrame, keys: list[str], rank: Column, k: int = 10) -> DataFrame:
    """One relevant item a row with its rank (null: not found): hit@1, hit@k, MRR, nDCG@k, P@k, mean rank when found."""
    inside = rank <= k
    gain = F.when(inside, 1 / F.log2(rank + 1)).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(rank == 1, 1.0).otherwise(0.0)), 6).alias("hit_1"),
        F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias("hit_k"),
        F.round(F.avg(F.when(inside, 1 / rank).otherwise(0.0)), 6).alias("mrr"),
        F.round(F.avg(gain), 6).alias("ndcg"),
        F.round(F.avg(F.when(inside, F.lit(1.0) / k).otherwise(0.0)), 6).alias("p_k"),
        F.round(F.avg(rank), 6).alias("mean_rank"),
    )


def set_overlap(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Totals over all rows of two arrays: tp, fp, fn and precision, recall, F1, IoU."""
    tp, fp, fn = F.size(F.array_intersect(predicted, truth)), F.size(F.array_except(predicted, truth)), F.size(F.array_except(truth, predicted))
    return derived(df.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn")))


def derived(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return df.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "iou": share(tp, tp + fp + fn)})


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: tp, fp, fn, support and the derived measures, from the confusion counts."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"), "truth", "predicted", "n").select("x.*", "truth", "predicted", "n")
    hit = F.col("truth") == F.col("predicted")
    sums = sides.groupBy("label").agg(F.sum(F.when(hit & (F.col("side") == "t"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit & (F.col("side") == "p"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit & (F.col("side") == "t"), F.col("n")).otherwise(0)).alias("fn"))
    return derived(sums.filter("label is not null"))


def mcnemar(df: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """Discordant counts and the exact two-sided binomial p. The sum is over the smaller count, on one row."""
    row = df.agg(F.count_if(a_right & ~b_right).alias("n10"), F.count_if(~a_right & b_right).alias("n01")).first()
    n, k = row["n10"] + row["n01"], min(row["n10"], row["n01"])
    p = min(1.0, float(2 * sum(comb(n, i) for i in range(k + 1)) / (1 << n))) if n else 1.0
    return df.sparkSession.createDataFrame([(row["n10"], row["n01"], round(p, 9))], "n10 bigint, n01 bigint, p_value double")


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlations, all in one pass."""
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("pearson")) for a, b in pairs)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def average_precision(df: DataFrame, by: list[str], order: list[Column], relevant: Column) -> DataFrame:
    """(by, n, n_relevant, ap): the mean over a list's relevant rows of the share of relevant rows up to each; null without any."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = relevant.cast("int")
    rows = df.select(*by, hit.alias("_hit"), (F.sum(hit).over(w) / F.count(F.lit(1)).over(w)).alias("_p"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("n_relevant"), (F.sum(F.col("_p") * F.col("_hit")) / F.nullif(F.sum("_hit"), F.lit(0))).alias("ap"))


def importance(df: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """(parameter, levels, effect, importance): the spread of a parameter's level means, and the share of the metric's variance that lies between
    its levels. Sums by level are taken once for all parameters; rows without the metric don't count."""
    cells = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("level")) for p in parameters))
    x = F.col(metric).cast("double")
    levels = df.filter(x.isNotNull()).select(F.explode(cells).alias("c"), x.alias("x")).groupBy("c.parameter", "c.level").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = levels.groupBy("parameter").agg(F.count(F.lit(1)).alias("levels"), (F.max("m") - F.min("m")).alias("effect"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"), F.sum(F.col("n") * F.col("v")).alias("_within"))
    between = levels.join(whole.select("parameter", "_mean"), "parameter").groupBy("parameter").agg(F.sum(F.col("n") * (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean"))).alias("_between"))
    share = F.when(F.col("_between") + F.col("_within") > 0, F.col("_between") / (F.col("_between") + F.col("_within"))).otherwise(0.0)
    return whole.join(between, "parameter").select("parameter", "levels", "effect", share.alias("importance"))
