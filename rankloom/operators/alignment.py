"""Matching labels and phrases that are alike but not equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def likeness(a: Column, b: Column, contained: int = 3) -> Column:
    """1 if one holds the other and that has ``contained`` characters or more, else 1 - edit distance / longer length."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when((shorter >= contained) & (F.contains(a, b) | F.contains(b, a)), 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def aligned(predicted: str, truth: str, cutoff: float = 0.5) -> Column:
    """One-to-one pairs (i, j) of two short label arrays, the likest first (ties: by position), none under ``cutoff``."""

    def pairs(p: Column, i: Column) -> Column:
        return F.transform(truth, lambda t, j: F.struct((-likeness(p, t)).alias("away"), i.alias("i"), j.alias("j")))

    def take(s: Column, p: Column) -> Column:
        used = F.exists(s, lambda x: (x["i"] == p["i"]) | (x["j"] == p["j"]))
        return F.when(used, s).otherwise(F.concat(s, F.array(F.struct(p["i"].alias("i"), p["j"].alias("j")))))

    likely = F.array_sort(F.filter(F.flatten(F.transform(predicted, pairs)), lambda x: x["away"] <= -cutoff))
    return F.aggregate(likely, F.array().cast("array<struct<i:int,j:int>>"), take)


def one_edit_apart(left: DataFrame, right: DataFrame, short: int = 40) -> DataFrame:
    """(a, b) of the distinct words in the only column of each frame whose edit distance is 1 or 0. Such words share a
    form with one letter less, so the join is an equality; a form has few words (one letter in one place). Words of ``short``
    letters and more, whose forms would be as long as their square, share their first or their last half of that many letters
    instead: the edit is not in both. Words of exactly that length go both ways."""
    half = short // 2
    forms = "array_distinct(concat(array(w), transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1)))))"

    def spread(df: DataFrame, name: str, lengths: str) -> DataFrame:
        ends = f"flatten(transform(array({lengths}), n -> array(concat('<', length(w) + n, ' ', left(w, {half})), concat('>', length(w) + n, ' ', right(w, {half})))))"
        none = "cast(array() AS array<string>)"
        every = f"concat(CASE WHEN length(w) <= {short} THEN {forms} ELSE {none} END, CASE WHEN length(w) >= {short} THEN {ends} ELSE {none} END)"
        return df.toDF("w").filter("length(w) > 0").select(F.col("w").alias(name), F.explode(F.expr(every)).alias("form"))

    both = spread(left, "a", "0").join(spread(right, "b", "-1, 0, 1"), "form")
    return both.filter(F.levenshtein("a", "b", 1) >= 0).select("a", "b").distinct()
