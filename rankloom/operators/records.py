"""Predicates on records, lookups, merges, summaries and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import kept

#: Rows or ids of a bundle, ids of a run, pairs of bundles of a task and most tasks of a fan-out.
BUNDLE, RUN, PAIRS, MOST_TASKS = 4096, 256, 16, 1 << 14
PLACEHOLDERS = "(?i)lorem ipsum|todo|coming soon|more information needed"


def description_problems(text: Column, word: str) -> list[Column]:
    """bad: null, under 100 characters, or under 50 distinct words and a placeholder. bad_strict: also few words that repeat one,
    under 20 words, or a placeholder anywhere. latin: nothing beyond Latin letters, digits and signs."""
    given = F.coalesce(text, F.lit(""))
    n, k = F.length(F.trim(given)), F.size(F.array_distinct(F.filter(F.split(given, r"\s+"), lambda w: w != "")))
    hits, holds = (F.length(given) - F.length(F.replace(given, F.lit(word), F.lit("")))) / len(word), given.rlike(PLACEHOLDERS)
    short = text.isNull() | (n < 100)
    return [(short | ((k < 50) & holds)).alias("bad"), (short | ((k < 30) & (hits > 5)) | (k < 20) | holds).alias("bad_strict"), given.rlike(r"^[\x{0000}-\x{024F}\s]*$").alias("latin")]


def popularity(likes: str, changed: str, low: str, many: int, year: int) -> Column:
    """keep above ``many`` likes; with some, by the year, then by the set of little used ones; bad without any."""
    by_date = F.when(F.col(changed).isNull(), "bad").when(F.year(changed) > year, "keep").when(F.coalesce(F.col(low), F.lit(False)), "bad").otherwise("keep")
    return F.when(F.col(likes) > many, "keep").when(F.col(likes) >= 1, by_date).otherwise("bad")


def about(c: Column, value: float) -> Column:
    gap = max(1e-3, abs(value) / 10)
    return c.between(value - gap, value + gap)


def rating_threshold(rating: int, most: int = 5) -> float:
    """A rating from 1 to ``most`` as a share."""
    return (rating - 1) / (most - 1)


def phrase_verdict(c: Column, stop: tuple[str, ...], prefixes: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return F.when(~c.rlike("[A-Za-z]"), "symbols").when(low.rlike("^(the|a|an|this|that) "), "determiner").when(low.isin(*stop), "stop").when(c.rlike("[0-9]"), "digits").when(low.rlike(f"^({'|'.join(prefixes)})"), "prefix").otherwise("valid")


def phrase_hits(texts: DataFrame, aliases: DataFrame, text_id: str, alias_id: str, words: str = "w") -> DataFrame:
    """(text_id, alias_id) where a text's words hold an alias's words in order. A text and an alias meet by the alias's longest
    word (the first of several)."""
    key = F.element_at(F.array_sort(F.transform(F.array_distinct(words), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    a = aliases.filter(F.size(words) > 0).select(alias_id, padded(words).alias("_alias"), key.alias("_key"))
    wanted = a.select("_key").distinct()
    met = texts.select(text_id, F.explode(F.array_distinct(words)).alias("_key")).join(wanted, "_key", "left_semi").join(a, "_key")
    return met.join(texts.select(text_id, padded(words).alias("_text")), text_id).filter(F.contains("_text", F.col("_alias"))).select(text_id, alias_id)


def first_found(df: DataFrame, tables: list[tuple[DataFrame, str]], value: str, name: str) -> DataFrame:
    """df with the value that the first of the tables has for its key; each key is unique in its table."""
    found = []
    for i, (t, key) in enumerate(tables):
        df = df.join(t.withColumnRenamed(value, f"_{i}"), key, "left")
        found.append(f"_{i}")
    return df.withColumn(name, F.coalesce(*found)).drop(*found)


def similar_pairs(cells: DataFrame, key: str, least: float) -> DataFrame:
    """cells (key, i, v) of few vectors -> (a, b, cosine) of the pairs a < b at or above ``least``."""
    norm = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    unit = cells.join(norm, key).select(key, "i", (F.col("v") / F.col("n")).alias("v"))
    both = unit.select(F.col(key).alias("a"), "i", F.col("v").alias("va")).join(unit.select(F.col(key).alias("b"), "i", F.col("v").alias("vb")), "i").filter("a < b")
    return both.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("cosine")).filter(F.col("cosine") >= least)


def path_profile(values: DataFrame, doc: str, samples: int = 3) -> DataFrame:
    """values (doc, path, v) -> by path: documents, distinct values and the smallest of them, which come from the distinct ones."""
    docs = values.groupBy("path").agg(F.count_distinct(doc).alias("assigned"))
    distinct = values.select("path", "v").distinct()
    some = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("v"))).filter(F.col("_n") <= samples)
    return docs.join(distinct.groupBy("path").agg(F.count("v").alias("n_unique")), "path").join(some.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("samples")), "path")


def balanced_error(rates: DataFrame, spread: float, weakest: float) -> DataFrame:
    """rates (feature, set, rate) -> (feature, score): mean + spread * deviation + weakest * rate in the set with the worst mean."""
    worst = rates.groupBy("set").agg(F.avg("rate").alias("m")).agg(F.max_by("set", F.struct("m", "set")).alias("w"))
    marked = rates.withColumn("w", worst.scalar())
    return marked.groupBy("feature").agg((F.avg("rate") + spread * F.stddev_pop("rate") + weakest * F.max(F.when(F.col("set") == F.col("w"), F.col("rate")))).alias("score"))


def averaged_report(rows: DataFrame) -> DataFrame:
    """rows (truth, predicted) -> accuracy, macro and weighted precision, recall and F1 in one row; 0 where a class has no rows."""
    cells = rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    either = cells.select(F.col("truth").alias("c"), F.col("n").alias("tt"), F.lit(0).alias("pp"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")).union(cells.select("predicted", F.lit(0), "n", F.lit(0)))
    m = either.groupBy("c").agg(F.sum("tt").alias("tt"), F.sum("pp").alias("pp"), F.sum("tp").alias("tp"))
    m = m.withColumn("p", F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0))).withColumn("r", F.coalesce(F.try_divide("tp", "tt"), F.lit(0.0)))
    m = m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    means = [F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("p", "r", "f1")] + [F.round(F.sum(F.col(c) * F.col("tt")) / F.sum("tt"), 6).alias(f"weighted_{c}") for c in ("p", "r", "f1")]
    return m.agg(F.round(F.sum("tp") / F.sum("tt"), 6).alias("accuracy"), *means)


def merged_rekeyed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """a and b in one; an entry of b whose key has another value in a gets a key of its own after the largest of both. The
    entries that clash are numbered by places (ranks.ranked), not in one task."""
    from .ranks import ranked

    met = b.join(a.select(key, F.col(value).alias("_other")), key, "left")
    clash = F.col("_other").isNotNull() & (F.col("_other") != F.col(value))
    last = a.select(key).union(b.select(key)).agg(F.max(key).alias("_m"))
    moved = ranked(met.filter(clash).select(key, value), key, [], "_n").select((F.col("_n") + last.scalar()).alias(key), value)
    return a.select(key, value).union(met.filter(~clash).select(key, value)).distinct().union(moved)


def numbered(df: DataFrame, groups: list[str], number: str, ties: list[str], name: str) -> DataFrame:
    """The place from 0 within a group, in order of a number, then of ties: counts by number give the offsets, so that only
    rows of one number are sorted in a task."""
    counts = df.groupBy(*groups, number).agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select(*groups, number, (F.sum("_k").over(Window.partitionBy(*groups).orderBy(number)) - F.col("_k")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*groups, number).orderBy(*ties)) - 1
    return df.withColumn(name, nth).join(before, [*groups, number]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def balanced_sample(df: DataFrame, key: str, number: str, size: int) -> DataFrame:
    """``size`` rows above the median and ``size`` others, by the hash of their key; what one side lacks is filled from the rest."""
    middle = df.agg(F.percentile(number, 0.5).alias("m"))  # counts of distinct values, combined before they meet
    rows = df.select(key, (F.col(number) > middle.scalar()).alias("popular"), F.md5(F.col(key).cast("string")).alias("_h"))
    sides = [rows.filter(F.col("popular") == p).orderBy("_h").limit(size) for p in (True, False)]
    first = reduce(DataFrame.union, sides)
    rest = rows.join(F.broadcast(first.select(key)), key, "left_anti").orderBy("_h").limit(2 * size)
    every = first.withColumn("filler", F.lit(False)).unionByName(rest.withColumn("filler", F.lit(True)))
    nth = F.row_number().over(Window.orderBy("filler", "_h"))  # 4 * size rows at most
    return every.withColumn("_n", nth).filter(F.col("_n") <= 2 * size).select(key, "popular", "filler")


def fanned(rows: DataFrame, names: DataFrame, name: str, id_col: str, bundle: int = BUNDLE) -> DataFrame:
    """rows with every id that bears their name; null where none does. names (name, id).

    The rows and the ids of a name are dealt into bundles of about ``bundle``, equal ones into the same, and each pair of bundles is unfolded by
    itself where the result is written: what is shuffled is bundles by bundles, not rows by ids, and a name that many bear is
    many tasks' work. A row meets RUN ids in a run before the next row does, so that a columnar file of the result repeats itself within
    a page, and a task has few enough pairs for its dictionaries."""
    spark = rows.sparkSession
    asked, borne = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n")), names.groupBy(name).agg(F.count(F.lit(1)).alias("_m"))
    bundles = lambda c: F.ceil(F.col(c) / bundle).cast("int")
    deal = kept(asked.join(borne, name, "left").select(F.col(name).alias("_name"), bundles("_n").alias("_rows"), bundles("_m").alias("_ids")), "deal")
    pairs = deal.agg(F.sum(F.col("_rows").cast("long") * F.coalesce("_ids", F.lit(1)))).first()[0] or 0
    tasks = min(MOST_TASKS, max(4 * spark.sparkContext.defaultParallelism, -(-pairs // PAIRS)))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    of_name = rows.join(deal, F.col(name).eqNullSafe(F.col("_name"))).withColumn("_r", F.pmod(F.xxhash64(*rows.columns), F.col("_rows")).cast("int"))
    left = of_name.groupBy("_name", "_r", "_ids").agg(F.collect_list(F.struct(*rows.columns)).alias("_row")).select("_name", "_r", every("_ids").alias("_i"), "_row")
    code = F.xxhash64(id_col)
    run = F.pmod(F.shiftright(code, 32), F.lit(-(-bundle // RUN))).cast("int")
    of_id = names.join(deal, F.col(name) == F.col("_name")).select("_name", "_rows", F.pmod(code, F.col("_ids")).cast("int").alias("_i"), run.alias("_run"), id_col)
    runs = of_id.groupBy("_name", "_rows", "_i", "_run").agg(F.collect_list(F.struct(id_col)).alias("_x")).withColumn("_x", F.col(f"_x.{id_col}"))
    right = runs.groupBy("_name", "_rows", "_i").agg(F.collect_list("_x").alias("_runs")).select("_name", every("_rows").alias("_r"), "_i", "_runs")
    keys = ["_name", "_r", "_i"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys, "left")
    none = F.array(F.array(F.lit(None).cast(names.schema[id_col].dataType)))
    # generated code hands on all rows that come of one row at once; coalesce, which merges nothing here, ends its reach
    by_run = met.select("_row", F.explode(F.coalesce("_runs", none)).alias("_run")).coalesce(tasks)
    by_row = by_run.select(F.explode("_row").alias("_row"), "_run").select("_row.*", "_run").coalesce(tasks)
    return by_row.select(*rows.columns, F.explode("_run").alias(id_col))
