"""Places in a total order of a whole table, without one task that sorts it all.

The order is cut at quantiles of a number. Counts of the parts give each part's offset, and rows are numbered within
their part. Where the quantiles fall changes the sizes of the parts, never a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def _part(df: DataFrame, number: str, parts: int) -> Column:
    cuts = df.approxQuantile(number, [k / parts for k in range(1, parts)], 0.005) if parts > 1 else []
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted({*cuts}))).cast("array<double>"), lambda c: c <= F.col(number))) if cuts else F.lit(0)


def ranked(df: DataFrame, number: str, ties: list[str], name: str, parts: int = PARTS) -> DataFrame:
    """df with the place (from 1) of each row in order of a number, then of ties. Rows without the number come first."""
    cut = df.withColumn("_part", F.when(F.col(number).isNull(), -1).otherwise(_part(df, number, parts)))
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part, PARTS at most
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(number, *ties))
    return cut.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + nth).drop("_part", "_before")


def average_ranks(df: DataFrame, number: str, name: str, parts: int = PARTS) -> DataFrame:
    """df with the mean place of the rows that share a number: what rank correlations take. Rows without it have none."""
    values = df.filter(F.col(number).isNotNull()).groupBy(number).agg(F.count(F.lit(1)).alias("_n"))
    cut = values.withColumn("_part", _part(df, number, parts))
    before = cut.groupBy("_part").agg(F.sum("_n").alias("_m"))
    before = before.select("_part", (F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).alias("_before"))
    up_to = F.sum("_n").over(Window.partitionBy("_part").orderBy(number))
    placed = cut.join(F.broadcast(before), "_part").select(number, (F.col("_before") + up_to - (F.col("_n") - 1) / 2).alias(name))
    return df.join(placed, number, "left")


def at_shares(df: DataFrame, number: str, shares: list[float], parts: int = PARTS) -> DataFrame:
    """(share, value): the number at the place round(share * (n - 1)), halves to even, among the rows that have one."""
    some = df.filter(F.col(number).isNotNull()).select(number)
    places = ranked(some, number, [], "_place", parts)
    wanted = some.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*map(F.lit, shares))).alias("share"), (F.bround(F.col("share") * (F.col("_n") - 1), 0) + 1).cast("long").alias("_place"))
    return places.join(F.broadcast(wanted), "_place").select("share", F.col(number).alias("value"))
