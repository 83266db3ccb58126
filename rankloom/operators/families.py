"""Hierarchies, families and domains: who belongs where, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCLEAR = "Other / Unclear"


def root_paths(edges: DataFrame, most: int = 32) -> DataFrame:
    """edges (child, parent) -> (leaf, path: root first, depth) of every child that is no parent. One join a level; a
    cycle, or a path of over ``most`` levels, is an error."""
    parents = edges.select(F.col("parent").alias("child")).distinct()
    now = edges.join(parents, "child", "left_anti").select(F.col("child").alias("leaf"), F.col("parent").alias("top"), F.array("parent", "child").alias("path"))
    done = None
    for _ in range(most):
        up = now.join(edges.select(F.col("child").alias("top"), F.col("parent").alias("above")), "top", "left")
        ended = up.filter("above IS NULL").select("leaf", "path")
        done = ended if done is None else done.union(ended)
        now = up.filter("above IS NOT NULL").select("leaf", F.col("above").alias("top"), F.concat(F.array("above"), "path").alias("path"))
        if now.isEmpty():
            return done.select("leaf", "path", F.size("path").alias("depth"))
    raise ValueError(f"a path of over {most} levels")


def assigned(scores: DataFrame, key: str, margin: float, tie_bonus: float) -> DataFrame:
    """scores (key, candidate, score, boost, tagged) -> (key, candidate, z, margin): scores as z-scores over a row's candidates
    (deviation 0: all 0), boosts added; where the best two are closer than ``margin``, a tagged candidate gets tie_bonus."""
    means = scores.groupBy(key).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("score") - F.col("_m")) / F.col("_s")).otherwise(0.0) + F.col("boost")
    rows = scores.join(means, key).select(key, "candidate", z.alias("z"), "tagged")
    best = rows.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("z", "candidate")), False), 1, 2).alias("t"))  # candidates are few
    gap = F.col("t")[0]["z"] - F.coalesce(F.get("t", F.lit(1))["z"], F.lit(float("-inf")))
    final = rows.join(best.select(key, gap.alias("_gap")), key).withColumn("z", F.col("z") + F.when((F.col("_gap") < margin) & F.col("tagged"), tie_bonus).otherwise(0.0))
    return final.groupBy(key).agg(F.max(F.struct("z", "candidate")).alias("x"), F.first("_gap").alias("margin")).select(key, "x.candidate", "x.z", "margin")


def cascade(rules: list[tuple[str, Column, float]], unclear: str = UNCLEAR) -> Column:
    """struct(family, confidence, rule) of the first rule whose family is not null."""
    found = [F.when(family.isNotNull(), F.struct(family.alias("family"), F.lit(c).cast("double").alias("confidence"), F.lit(name).alias("rule"))) for name, family, c in rules]
    return F.coalesce(*found, F.struct(F.lit(unclear).alias("family"), F.lit(0.0).alias("confidence"), F.lit("none").alias("rule")))


def alias_choice(scores: dict[str, Column], least: float, margin: float) -> Column:
    """The family with the best score if it reaches ``least`` and leads the next by ``margin``, else null."""
    order = F.sort_array(F.array(*(F.struct(s.cast("double").alias("s"), F.lit(k).alias("k")) for k, s in scores.items())), False)
    return F.when((order[0]["s"] >= least) & (order[0]["s"] - (order[1]["s"] if len(scores) > 1 else F.lit(0.0)) >= margin), order[0]["k"])


def inherited(df: DataFrame, key: str, base: str, family: str, passes: int = 2) -> DataFrame:
    """df with family filled from that of its base, ``passes`` times; hop says after how many (0: its own)."""
    df = df.withColumn("hop", F.when(F.col(family).isNotNull(), 0))
    for n in range(1, passes + 1):
        known = df.filter(F.col(family).isNotNull()).select(F.col(key).alias(base), F.col(family).alias("_f"))
        df = df.join(known, base, "left").withColumn("hop", F.coalesce("hop", F.when(F.col("_f").isNotNull(), n))).withColumn(family, F.coalesce(family, "_f")).drop("_f")
    return df


def discovered(tokens: DataFrame, least: int, hit_rate: float, place: float, coherence: float, roots: int) -> DataFrame:
    """tokens (root, model, place, from_base, kind) -> roots to promote: frequent enough, often named by a base model, early in the
    name, with one kind in enough of their models, and not spread over too many kinds."""
    kinds = tokens.groupBy("root", "kind").agg(F.count(F.lit(1)).alias("k"))
    spread = kinds.groupBy("root").agg(F.count(F.lit(1)).alias("n_kinds"), (F.max("k") / F.sum("k")).alias("coherence"))
    places = tokens.groupBy("root", "place").agg(F.count(F.lit(1)).alias("w"), F.sum("from_base").alias("b"))
    stats = places.groupBy("root").agg(F.sum("w").alias("n"), (F.sum("b") / F.sum("w")).alias("hit_rate"), F.percentile("place", 0.5, F.col("w")).alias("place"))
    ok = (F.col("n") >= least) & (F.col("hit_rate") >= hit_rate) & (F.col("place") <= place) & (F.col("coherence") >= coherence) & (F.col("n_kinds") < roots)
    return stats.join(spread, "root").withColumn("promoted", ok)


def feasible_order(filters: list[tuple[str, Column, int, str, float]]) -> list[tuple[str, Column, int, str, float]]:
    """(name, filter, bucket, priority, weight): what is given up first: semantic ones (bucket 0) before structured ones,
    strong_prefer before must, the cheapest first."""
    return sorted(filters, key=lambda f: (f[2], f[3] == "must", f[4], f[0]))


def relaxed(df: DataFrame, hard: Column, filters: list[tuple[str, Column, int, str, float]], target: int) -> tuple[int, DataFrame]:
    """(level, df with the level at which a row first comes in, null if never). Level n gives up the first n filters; the
    chosen level is the first with ``target`` rows, else the last. All levels are counted in one pass."""
    order = feasible_order(filters)
    levels = [reduce(lambda a, b: a & b, [f[1] for f in order[n:]], hard) for n in range(len(order) + 1)]
    counts = df.agg(*(F.count_if(c).alias(f"n{n}") for n, c in enumerate(levels))).first()
    chosen = next((n for n in range(len(levels)) if counts[n] >= target), len(order))
    return chosen, df.withColumn("level", F.coalesce(*(F.when(c, n) for n, c in enumerate(levels))))


def by_tables(models: DataFrame, hints: DataFrame, patterns: DataFrame, aliases: DataFrame, least: float = 0.28, margin: float = 0.08, alias_confidence: float = 0.80, unclear: str = UNCLEAR) -> DataFrame:
    """models (id, kind, name, tags) -> (id, family, child, confidence, rule), from tables of any size, by equality joins:

    hint      hints (kind, family, child, confidence): the record's kind, whatever its case; the surest, ties to the lesser family
    pattern   patterns (phrase, family, child, confidence): words that stand side by side in the name; the longest phrase
    alias     aliases (field, word, family, weight), field being name, tag or kind: weights of the words that a field has,
              each word once a field, are summed by family; the best family if it reaches ``least`` and leads the next by ``margin``
    none      ``unclear``, with confidence 0

    The first that finds something counts. Names and tags are split at what is no letter or digit. Nulls have no words; ids are unique."""
    from .languages import mentions

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}0-9]+"), lambda w: w != ""))
    plain = F.array_join(F.filter(F.split(F.lower(F.coalesce("name", F.lit(""))), r"[^\p{L}0-9]+"), lambda w: w != ""), " ")
    # records of one kind, name and tags are one class, and one row a class goes through the joins
    all_ = models.select("id", F.sha2(F.to_json(F.struct("kind", "name", "tags")), 256).alias("key"), "kind", "name", "tags")
    own = all_.drop("id").distinct().select(F.col("key").alias("id"), F.lower("kind").alias("kind"), plain.alias("t"), words(F.coalesce("name", F.lit(""))).alias("n"), words(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")).alias("g"), words(F.coalesce("kind", F.lit(""))).alias("k"))
    best_hint = hints.groupBy(F.lower("kind").alias("kind")).agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "family", "child")).alias("h"))
    hit = F.struct("family", "child", "confidence")
    seen = mentions(own.select("t").filter("t <> ''").distinct(), patterns.select(F.lower("phrase").alias("said"), hit.alias("hit"))).withColumnRenamed("mention", "p")
    cells = F.flatten(F.array(*(F.transform(c, tagged) for c, tagged in (("n", lambda w: F.struct(F.lit("name").alias("field"), w.alias("word"))), ("g", lambda w: F.struct(F.lit("tag").alias("field"), w.alias("word"))), ("k", lambda w: F.struct(F.lit("kind").alias("field"), w.alias("word")))))))
    said = own.select("id", F.explode(cells).alias("x")).select("id", "x.field", "x.word").join(aliases.withColumn("word", F.lower("word")), ["field", "word"])
    sums = said.groupBy("id", "family").agg(F.round(F.sum("weight"), 9).alias("w"))
    top = sums.groupBy("id").agg(F.max(F.struct("w", "family")).alias("best"), F.sum(F.lit(1)).alias("m"), F.sort_array(F.collect_list("w"), False).alias("all"))  # a row a family
    chosen = top.filter((F.col("best.w") >= least) & (F.round(F.col("best.w") - F.when(F.col("m") > 1, F.col("all")[1]).otherwise(0.0), 9) >= margin)).select("id", F.col("best.family").alias("alias"))
    rows = own.select("id", "kind", "t").join(best_hint, "kind", "left").join(seen, "t", "left").join(chosen, "id", "left")
    pick = lambda family, child, confidence, rule: F.struct(family.alias("family"), child.cast("string").alias("child"), confidence.cast("double").alias("confidence"), F.lit(rule).alias("rule"))
    found = F.coalesce(
        F.when(F.col("h").isNotNull(), pick(F.col("h.family"), F.col("h.child"), -F.col("h.minus"), "hint")),
        F.when(F.col("p").isNotNull(), pick(F.col("p.family"), F.col("p.child"), F.col("p.confidence"), "pattern")),
        F.when(F.col("alias").isNotNull(), pick(F.col("alias"), F.lit(None), F.lit(alias_confidence), "alias")),
        pick(F.lit(unclear), F.lit(None), F.lit(0.0), "none"),
    )
    classes = rows.select(F.col("id").alias("key"), found.alias("x"))
    return all_.select("id", "key").join(classes, "key").select("id", "x.*")


def routed(texts: DataFrame, words: DataFrame, several: str = "multimodal", other: str = "other") -> DataFrame:
    """texts (id, text), words (word, route) -> (id, route, routes): the route that a text's words name; ``several`` where they name more
    than one, ``other`` where none. routes: all of them, in order."""
    each = texts.select("id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}0-9]+"))).alias("word")).join(words.select(F.lower("word").alias("word"), "route"), "word")
    named = each.groupBy("id").agg(F.array_sort(F.collect_set("route")).alias("routes"))  # at most as many as there are routes
    none = F.array().cast("array<string>")
    all_ = texts.select("id").join(named, "id", "left").withColumn("routes", F.coalesce("routes", none))
    return all_.select("id", F.when(F.size("routes") > 1, several).when(F.size("routes") == 1, F.col("routes")[0]).otherwise(other).alias("route"), "routes")
