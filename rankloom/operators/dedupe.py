"""Choosing one of several rows, and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Ranks above the limit don't leave their task (Spark's window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: Column | int) -> DataFrame:
    """Up to k rows a group; k may be a column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fingerprint(*cols: str) -> Column:
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def merged_right_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full join; where both have a value, the right one's counts."""
    left, right = a.alias("l"), b.alias("r")
    cols = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c != key]
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, d in (("r", b), ("l", a)) if c in d.columns)).alias(c)
    return left.join(right, F.col(f"l.{key}") == F.col(f"r.{key}"), "full").select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), *map(pick, cols))


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, place) of distinct keys: left, right or both. One shuffle of each side's distinct keys."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    got = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return got.select(key, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right").alias("place"))


def casefold_merged(df: DataFrame, phrase: str, id_col: str) -> DataFrame:
    """(key, display, n_rows, n_ids): phrases equal but for case; shown in mixed case if there is one, then longest, then first."""
    p = F.col(phrase)
    mixed = ((F.col("form") != F.lower("form")) & (F.col("form") != F.upper("form"))).cast("int")
    # forms and ids are counted apart: forms are few and combined before the shuffle, and no row holds a form, its key and an id
    forms = df.groupBy(p.alias("form")).agg(F.count(F.lit(1)).alias("n"))
    shown = forms.groupBy(F.lower("form").alias("key")).agg(F.min_by("form", F.struct(-mixed, -F.length("form"), F.col("form"))).alias("display"), F.sum("n").alias("n_rows"))
    ids = df.select(F.lower(p).alias("key"), F.col(id_col).alias("_id")).distinct().groupBy("key").agg(F.count("_id").alias("n_ids"))
    return shown.join(ids, F.equal_null(shown["key"], ids["key"])).select(shown["key"], "display", "n_rows", "n_ids")
