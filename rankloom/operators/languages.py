"""Languages by tag, code, name or mention, from a reference table.

A tag is put in lower case, underscores become hyphens, white space single. Then the first of these that finds something counts:
special     the tag is in a table of special tags
code        the tag, then its part before the first hyphen, is a code (three-letter, two-letter, terminological, bibliographic)
name        the tag is a language's name
synonym     the tag is an alias, whose target is a name or code
mention     a name of four letters or more, or an alias of a name, stands in it between spaces: the longest, ties to the lesser

Each distinct tag is looked up once, by equality joins; mentions meet by the first word of a name. A tag may be a whole text:
its words become rows, each with as many words after it as the longest name has. Null and blank tags have no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 4
CODES = ("iso3", "part1", "part2t", "part2b")


def plain(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit("-"))), r"\s+", " "))


def _codes(reference: DataFrame) -> DataFrame:
    """(code, hit): of languages that share a code the one for which it comes first in CODES, then the lesser."""
    each = F.array(*(F.struct(plain(c).alias("code"), F.lit(k).alias("k")) for k, c in enumerate(CODES)))
    rows = reference.select("iso3", "name", F.explode(each).alias("x")).filter("x.code <> ''")
    return rows.groupBy(F.col("x.code").alias("code")).agg(F.min(F.struct("x.k", "iso3", "name")).alias("x")).select("code", F.struct("x.iso3", "x.name").alias("hit"))


def _names(reference: DataFrame) -> DataFrame:
    return reference.groupBy(plain("name").alias("said")).agg(F.min(F.struct("iso3", "name")).alias("hit"))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (t), names (said, hit) -> (t, hit) of the longest name in each text that has one."""
    words = F.split("said", " ")
    known = names.filter(F.length("said") > 0).select("said", "hit", words[0].alias("first"), F.size(words).alias("n"))
    most = known.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    own = texts.select("t", F.split("t", " ").alias("w"))
    windows = F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice("w", i + 1, F.lit(most)).alias("after")))
    met = own.select("t", F.explode(windows).alias("x")).select("t", "x.first", "x.after").join(known, "first")
    met = met.filter(F.array_join(F.slice("after", F.lit(1), F.col("n")), " ") == F.col("said"))
    return met.groupBy("t").agg(F.min(F.struct((-F.length("said")).alias("long"), "said", "hit")).alias("x")).select("t", F.col("x.hit").alias("mention"))


def resolved(tags: DataFrame, tag: str, reference: DataFrame, special: DataFrame, synonyms: DataFrame) -> DataFrame:
    """tags with iso3, language and found_by. reference: (iso3, part1, part2t, part2b, name); special: (tag, iso3, name); synonyms: (alias, target)."""
    codes, names = _codes(reference), _names(reference)
    t = tags.select(plain(tag).alias("t")).filter("t <> ''").distinct()
    hit = lambda df, key, name: df.select(F.col(key).alias("_key"), F.col("hit").alias(name))
    look = lambda left, on, right: left.join(right, on == F.col("_key"), "left").drop("_key")
    specials = special.select(plain("tag").alias("tag"), F.struct("iso3", "name").alias("hit"))
    targets = synonyms.select(plain("alias").alias("alias"), plain("target").alias("target")).groupBy("alias").agg(F.min("target").alias("target"))
    targets = look(look(targets, F.col("target"), hit(names, "said", "by_name")), F.col("target"), hit(codes, "code", "by_code"))
    rows = look(t, F.col("t"), hit(specials, "tag", "special"))
    rows = look(rows, F.col("t"), hit(codes, "code", "code"))
    rows = look(rows, F.substring_index("t", "-", 1), hit(codes, "code", "primary"))
    rows = look(rows, F.col("t"), hit(names, "said", "name"))
    rows = look(rows, F.col("t"), hit(targets.select("alias", F.coalesce("by_name", "by_code").alias("hit")), "alias", "synonym"))
    sayings = names.filter(F.length("said") >= LEAST).unionByName(targets.filter("by_name is not null").select(F.col("alias").alias("said"), F.col("by_name").alias("hit")))
    open_ = rows.filter(F.coalesce("special", "code", "primary", "name", "synonym").isNull())
    rows = rows.join(mentions(open_.select("t"), sayings), "t", "left")
    steps = ("special", "code", "primary", "name", "synonym", "mention")
    how = F.coalesce(*(F.when(F.col(s).isNotNull(), "code" if s == "primary" else s) for s in steps))
    found = rows.select("t", F.coalesce(*steps).alias("x"), how.alias("found_by")).select("t", F.col("x.iso3").alias("iso3"), F.col("x.name").alias("language"), "found_by")
    return tags.withColumn("_t", plain(tag)).join(found.withColumnRenamed("t", "_t"), "_t", "left").drop("_t")
