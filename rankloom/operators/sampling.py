"""Quotas and samples by class, alike in every run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .rounds import kept


def quotas(counts: dict[str, int], total: int, least: int) -> dict[str, int]:
    """How many of ``total`` rows each class gives: ``least`` of each (or all it has), the rest in proportion to what is
    left of them, rounded by largest remainder (ties: by name). No class gives more than it has."""
    out = {k: min(n, least) for k, n in counts.items()}
    room = {k: n - out[k] for k, n in counts.items()}
    rest, space = max(0, min(total, sum(counts.values())) - sum(out.values())), sum(room.values())
    if rest:
        for k, r in room.items():
            out[k] += rest * r // space
        short = rest - sum(rest * r // space for r in room.values())
        for k in sorted(room, key=lambda k: (-(rest * room[k] % space), k))[:short]:
            out[k] += 1
    return out


def _rounded(t: DataFrame, share: str, total: int) -> DataFrame:
    """(class, n, quota): shares rounded down, and up for those with the largest remainders (ties: by class) until the total is reached."""
    low = t.withColumn("quota", F.floor(F.col(share) + 1e-9)).withColumn("_minus", -F.round(F.col(share) - F.col("quota"), 9))
    short = total - (low.agg(F.sum("quota")).first()[0] or 0)
    return ranks.ranked(low, "_minus", ["class"], "_nth").select("class", "n", (F.col("quota") + (F.col("_nth") <= short).cast("int")).cast("long").alias("quota"))


def quota_table(counts: DataFrame, total: int, least: int) -> DataFrame:
    """counts (class, n) -> (class, n, quota) as ``quotas`` has them, for any number of classes."""
    based = counts.withColumn("base", F.least("n", F.lit(least)))
    s = based.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("base"), F.lit(0)).alias("base")).first()
    rest, space = max(0, min(total, s["n"]) - s["base"]), s["n"] - s["base"]
    if not rest:
        return based.select("class", "n", F.col("base").cast("long").alias("quota"))
    room = F.col("n") - F.col("base")
    part = based.withColumn("part", F.floor(room * rest / space + 1e-12)).withColumn("_minus", -(room * rest % space))
    short = rest - part.agg(F.sum("part")).first()[0]
    return ranks.ranked(part, "_minus", ["class"], "_nth").select("class", "n", (F.col("base") + F.col("part") + (F.col("_nth") <= short).cast("int")).cast("long").alias("quota"))


def _moved(t: DataFrame, amount: float, limit: str, weight: str, sign: int) -> DataFrame:
    """t with ``amount`` added to (sign 1) or taken from (-1) its shares in proportion to a weight, none beyond its limit: what a class can't
    take goes to the others, round by round, until all is placed or no class has room. Each round fills a class or ends."""
    room = F.greatest((F.col(limit) - F.col("share")) * sign, F.lit(0.0))
    while amount > 1e-9:
        s = t.agg(F.sum(room).alias("room"), F.sum(F.when(room > 1e-12, F.col(weight)).otherwise(0.0)).alias("weight"), F.count_if(room > 1e-12).alias("k")).first()
        if not s["k"] or s["room"] <= 1e-9:
            break
        give = min(amount, s["room"])
        by = F.col(weight) / s["weight"] if s["weight"] > 0 else F.lit(1.0 / s["k"])
        step = F.when(room > 1e-12, F.least(by * give, room)).otherwise(0.0)
        t = kept(t.withColumn("_step", step).withColumn("share", F.col("share") + sign * F.col("_step")), "shares")
        amount -= t.agg(F.sum("_step")).first()[0]
        t = t.drop("_step")
    return t


def rebalanced(counts: DataFrame, total: int, least: int, ideal: int) -> DataFrame:
    """counts (class, n) -> (class, n, quota): shares of total in proportion to n; then none under ``least``, at the expense of those above
    it; then those under ``ideal`` brought towards it, at the expense of those above; then none beyond its rows, the deficit going
    to classes with rows left. Rounded by largest remainder. All rows where there are no more than total."""
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = min(total, n)
    if not n:
        return counts.select("class", "n", F.col("n").cast("long").alias("quota"))
    base = counts.select("class", "n", F.col("n").cast("double").alias("rows"), (F.col("n") * float(total) / n).alias("share"))
    base = base.withColumns({"least": F.least(F.lit(float(least)), "rows"), "ideal": F.least(F.lit(float(ideal)), "rows")})
    t = kept(base.withColumn("share", F.greatest("share", "least")), "shares")
    t = _moved(t.withColumn("was", F.col("share")), t.agg(F.sum("share")).first()[0] - total, "least", "was", -1)
    gap = t.agg(F.sum(F.greatest(F.col("ideal") - F.col("share"), F.lit(0.0))).alias("lack"), F.sum(F.greatest(F.col("share") - F.col("ideal"), F.lit(0.0))).alias("spare")).first()
    moved = min(gap["lack"], gap["spare"])
    receivers, donors = F.when(F.col("share") < F.col("ideal"), F.col("ideal")).otherwise(F.col("share")), F.when(F.col("share") > F.col("ideal"), F.col("ideal")).otherwise(F.col("share"))
    t = t.withColumns({"up": receivers, "down": donors, "was": F.col("share")})
    t = _moved(_moved(t, moved, "down", "was", -1), moved, "up", "rows", 1)
    over = t.agg(F.sum(F.greatest(F.col("share") - F.col("rows"), F.lit(0.0)))).first()[0]
    t = _moved(t.withColumn("share", F.least("share", "rows")), over + max(0.0, total - t.agg(F.sum("share")).first()[0]), "rows", "rows", 1)
    return _rounded(t, "share", total)


def taken(df: DataFrame, by: str, key: str, quota: DataFrame) -> DataFrame:
    """Rows of each class by the hash of their key, as many as its quota (class, quota). One scan; no task sees more of a class than each of
    the others' first rows, since those beyond the largest quota don't leave their task."""
    most = quota.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key))
    first = df.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return first.join(quota.select(F.col("class").alias("_class"), "quota"), F.col(by).eqNullSafe(F.col("_class"))).filter("_nth <= quota").select(*df.columns)


def counted(df: DataFrame, by: str) -> DataFrame:
    return kept(df.groupBy(F.col(by).alias("class")).agg(F.count(F.lit(1)).alias("n")), "classes")


def quota_sample(df: DataFrame, by: str, key: str, total: int, least: int) -> DataFrame:
    """``least`` rows of each class (or all it has), the rest of total in proportion to what is left. Any number of classes; a null is one."""
    return taken(df, by, key, kept(quota_table(counted(df, by), total, least), "quotas"))


def rebalanced_sample(df: DataFrame, by: str, key: str, total: int, least: int, ideal: int) -> DataFrame:
    return taken(df, by, key, kept(rebalanced(counted(df, by), total, least, ideal), "quotas"))


def _dimension(df: DataFrame, column: str) -> DataFrame:
    """(place from 0, value) of a column's distinct values in order: the values of one parameter, in one window."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().select((F.row_number().over(Window.orderBy("value")) - 1).alias("place"), "value")


def _points(df: DataFrame, columns: list[str], chosen: DataFrame) -> DataFrame:
    """chosen (nth, one place a column, as p0, p1 ...) with the values at those places."""
    out = chosen
    for k, c in enumerate(columns):
        out = out.join(_dimension(df, c).select(F.col("place").alias(f"p{k}"), F.col("value").alias(c)), f"p{k}").drop(f"p{k}")
    return out.select("nth", *columns)


def sizes(df: DataFrame, columns: list[str]) -> list[int]:
    return list(df.agg(*(F.count_distinct(c).alias(f"n{k}") for k, c in enumerate(columns))).first())


def grid_points(df: DataFrame, columns: list[str], n: int, start: int = 0) -> DataFrame:
    """(nth, values): n points of the grid of the columns' distinct values, spread over it: the first column turns fastest, and the stride is
    the next number from 0.618 of the grid's size on that has no divisor in common with it, so no point comes twice before all have."""
    size = sizes(df, columns)
    total = math.prod(size)
    if not total:
        return _points(df, columns, df.sparkSession.range(0).select(F.col("id").alias("nth"), *(F.lit(0).alias(f"p{k}") for k in range(len(size)))))
    stride = next(s for s in range(max(1, int(0.618 * total)), 2 * total + 2) if math.gcd(s, total) == 1)
    i, places, below = (F.lit(start) + F.col("id") * stride) % total, [], 1
    for k, x in enumerate(size):
        places.append((F.floor(i / below) % x).cast("int").alias(f"p{k}"))
        below *= x
    return _points(df, columns, df.sparkSession.range(min(n, total)).select(F.col("id").alias("nth"), *places))


def random_points(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """(nth, values): points drawn by the hash of seed and number, n draws; a point that came before is left out."""
    size = sizes(df, columns)
    draws = df.sparkSession.range(n if all(size) else 0).select(F.col("id").alias("nth"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("h"))
    # four hexadecimal digits of the hash for each of up to eight columns
    places = [(F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("long") % max(x, 1)).cast("int").alias(f"p{k}") for k, x in enumerate(size)]
    first = draws.select("nth", *places).groupBy(*(f"p{k}" for k in range(len(size)))).agg(F.min("nth").alias("nth"))
    return _points(df, columns, first)
