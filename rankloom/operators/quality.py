"""Votes, scores and record quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_mode(votes: list[Column]) -> Column:
    """The most frequent of a few votes, -1 on a tie; nulls don't vote. Equal votes lie side by side once they are sorted, so
    the longest run tells."""
    k = len(votes)

    def runs(s: Column) -> Column:
        out = []
        for r in range(k, 0, -1):
            found = [F.when(F.get(s, F.lit(i)) == F.get(s, F.lit(i + r - 1)), F.get(s, F.lit(i))) for i in range(k - r + 1)]
            first, last = (F.least(*found), F.greatest(*found)) if len(found) > 1 else (found[0], found[0])
            out.append(F.when(first == last, first).when(first < last, -1))
        return F.coalesce(*out)

    return F.get(F.transform(F.array(F.sort_array(F.array_compact(F.array(*votes)))), runs), F.lit(0)).cast("int")  # sorted once


def fuzzy_scores(df: DataFrame, keys: list[str], vote: Column, least: int = 3) -> DataFrame:
    """High over high and low votes (2 and 0; 1 is neutral), eligible from ``least`` such votes on."""
    high, low = F.count_if(vote == 2), F.count_if(vote == 0)
    out = df.groupBy(*keys).agg(high.alias("n_high"), low.alias("n_low"), F.count(F.lit(1)).alias("n_all"))
    n = F.col("n_high") + F.col("n_low")
    return out.withColumn("fuzzy_score", F.when(n > 0, F.round(F.col("n_high") / n, 3))).withColumn("eligible", n >= least)


def description_problem(text: Column, placeholders: list[str], least_chars: int = 100, least_words: int = 50) -> Column:
    """Null or short; or of few distinct words and with a placeholder pattern in it."""
    few = F.size(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))) < least_words
    return F.coalesce(F.length(F.trim(text)) < least_chars, F.lit(True)) | (few & F.rlike(F.lower(text), F.lit("|".join(placeholders))))


def low_popularity(likes: Column, modified: Column, low_downloads: Column, year: int = 2024) -> Column:
    """No likes, or up to three without recent change: after ``year`` keeps; no date is bad; else by downloads."""
    return F.when(likes > 3, False).when(F.coalesce(likes, F.lit(0)) < 1, True).when(modified.isNull(), True).when(F.year(modified) > year, False).otherwise(low_downloads)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, n_rows, share): all columns in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in df.columns)).alias("x"))
    out = row.select("n", F.explode("x").alias("x")).select("x.column", "x.n_null", F.col("n").alias("n_rows"))
    return out.withColumn("null_share", F.round(F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows")), 6))
