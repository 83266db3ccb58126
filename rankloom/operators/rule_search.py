"""Rules that bring predicted feature lists closer to several truths at once: features to remove everywhere, features to add everywhere.

The mean overlap (intersection by union, 1 for two empty lists) of each truth is taken over all rows; the objective is the
mean of these means less ``balance`` times their population standard deviation. Each step takes the rule that raises it
most, ties to "add" before "remove" and then to the lesser name, until none does.

One rule changes a row in four ways only: the feature is predicted or not, and true or not. So a step scores all rules
there are, over all rows, with one aggregate by feature over the features that rows have; adding a feature to the rows that lack it
is a sum over all rows, corrected for those that don't. A row's lists are split once as sets; of each part all features bring the
same, so that its cells carry numbers only. There is no shortlist of candidates and no sample of rows. A hot feature is combined
before the shuffle.

Rows with null lists have empty ones; repeated features count once, null features don't. No rows: no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import kept


def _clean(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def _list(features: list[str]) -> Column:
    return F.array(*map(F.lit, features)).cast("array<string>")


def with_rules(predicted: Column, removed: list[str], added: list[str]) -> Column:
    return F.array_union(F.array_except(predicted, _list(removed)), _list(added))


def _overlap(inter: Column, union: Column) -> Column:
    return F.when(union == 0, 1.0).otherwise(inter / union)


def overlaps(rows: DataFrame, predicted: str, truths: list[str], removed: list[str] = (), added: list[str] = ()) -> DataFrame:
    """One row: n, and for each truth its mean overlap under the rules."""
    p = with_rules(_clean(predicted), list(removed), list(added))
    at = lambda t: _overlap(F.size(F.array_intersect(p, _clean(t))), F.size(F.array_union(p, _clean(t))))
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(at(t)).alias(t) for t in truths))


def objective(means: list[Column], balance: float) -> Column:
    mean = sum(means[1:], means[0]) / len(means)
    spread = F.sqrt(sum(((m - mean) * (m - mean) for m in means[1:]), (means[0] - mean) * (means[0] - mean)) / len(means))
    return mean - balance * spread


def _cleaned(rows: DataFrame, predicted: str, truths: list[str]) -> DataFrame:
    return rows.select(_clean(predicted).alias("_p"), *(_clean(t).alias(f"_t{k}") for k, t in enumerate(truths)))


def _split(cleaned: DataFrame, truths: int) -> DataFrame:
    """Each truth as what is predicted too and what is in it alone."""
    return cleaned.select("_p", *(x for k in range(truths) for x in (F.array_intersect("_p", f"_t{k}").alias(f"_both{k}"), F.array_except(f"_t{k}", "_p").alias(f"_only{k}"))))


def _sizes(k: int) -> tuple[Column, Column]:
    return F.size(f"_both{k}"), F.size("_p") + F.size(f"_only{k}")


def scores(rows: DataFrame, predicted: str, truths: list[str], balance: float = 0.1, removed: list[str] = (), added: list[str] = ()) -> DataFrame:
    """(kind, feature, objective, one mean overlap a truth) of every rule that may come next: to remove a feature that some row
    predicts and no rule has added, to add one that some truth has, some row lacks and no rule has removed."""
    return _scores(_cleaned(rows, predicted, truths), truths, balance, removed, added)


def _scores(cleaned: DataFrame, truths: list[str], balance: float, removed: list[str], added: list[str]) -> DataFrame:
    each = range(len(truths))
    own = _split(cleaned.withColumn("_p", with_rules(F.col("_p"), list(removed), list(added))), len(truths))
    # by row: what a feature of each list brings, whichever it is
    whole, parts, lists = [F.count(F.lit(1)).alias("_n")], [], [F.col("_p")]
    for k in each:
        i, u = _sizes(k)
        base, out, loss = _overlap(i, u), i / (u + 1), _overlap(i, u - 1)
        whole += [F.sum(base).alias(f"_now{k}"), F.sum(out - base).alias(f"_bare{k}")]
        parts += [(loss - base).alias(f"_loss{k}"), (base - out).alias(f"_kept{k}"), ((i - 1) / F.greatest(u, F.lit(1)) - loss).alias(f"_less{k}"), ((i + 1) / F.greatest(u, F.lit(1)) - out).alias(f"_gain{k}")]
        lists += [F.col(f"_both{k}"), F.col(f"_only{k}")]
    # list 0: predicted, as if no truth had it; 2k + 1: predicted and in truth k, what differs then; 2k + 2: in truth k alone
    cells = own.select(*parts, F.posexplode(F.array(*lists)).alias("_list", "_features"))
    cells = cells.select("_list", *(f"_{x}{k}" for k in each for x in ("loss", "kept", "less", "gain")), F.explode("_features").alias("feature"))
    terms = [F.count_if(F.col("_list") == 0).alias("_n_p"), F.count_if(F.col("_list") > 0).alias("_n_true")]
    for k in each:
        pick = lambda first, n, second: F.sum(F.when(F.col("_list") == 0, F.col(first)).when(F.col("_list") == n, F.col(second)).otherwise(0.0))
        terms += [pick(f"_loss{k}", 2 * k + 1, f"_less{k}").alias(f"_rem{k}"), pick(f"_kept{k}", 2 * k + 2, f"_gain{k}").alias(f"_add{k}")]
    of = cells.groupBy("feature").agg(*terms).crossJoin(F.broadcast(own.agg(*whole)))  # one row
    means = lambda kind: [(F.col(f"_now{k}") + (F.col(f"_bare{k}") + F.col(f"_add{k}") if kind == "add" else F.col(f"_rem{k}"))) / F.col("_n") for k in each]
    remove = (F.col("_n_p") > 0) & ~F.array_contains(_list(list(added)), F.col("feature"))
    add = (F.col("_n_true") > 0) & (F.col("_n_p") < F.col("_n")) & ~F.array_contains(_list(list(removed)), F.col("feature"))
    rule = lambda kind, may: F.struct(may.alias("may"), F.lit(kind).alias("kind"), "feature", objective(means(kind), balance).alias("objective"), *(m.alias(t) for m, t in zip(means(kind), truths)))
    return of.select(F.inline(F.array(rule("remove", remove), rule("add", add)))).filter("may").drop("may")


def search(rows: DataFrame, predicted: str, truths: list[str], balance: float = 0.1, steps: int = 50, digits: int = 12) -> list[dict]:
    """The steps taken: kind, feature, objective and the means, the first without a rule. Objectives are compared to ``digits`` digits."""
    held = kept(_cleaned(rows, predicted, truths), "lists")
    start = _split(held, len(truths)).agg(*(F.avg(_overlap(*_sizes(k))).alias(t) for k, t in enumerate(truths))).select(objective([F.col(t) for t in truths], balance).alias("objective"), *truths).first()
    if start["objective"] is None:
        return []
    out = [{"step": 0, "kind": None, "feature": None, **start.asDict()}]
    removed, added = [], []
    for step in range(1, steps + 1):
        best = _scores(held, truths, balance, removed, added).withColumn("objective", F.round("objective", digits)).orderBy(F.desc("objective"), "kind", "feature").limit(1).collect()
        if not best or best[0]["objective"] <= round(out[-1]["objective"], digits):
            break
        (removed if best[0]["kind"] == "remove" else added).append(best[0]["feature"])
        out.append({"step": step, **best[0].asDict()})
    return out


#: Cells that a task packs, and the part of all cells from which a feature's place goes to all tasks (so that few can).
CELLS, HOT = 1 << 17, 1 / 4096


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def packed(rows: DataFrame, key: str | list[str], lists: dict[str, str], places: DataFrame, within: str | None = None) -> DataFrame:
    """(key, word, a column of 64 bits for each list) of the words that have any bit. places: (feature, place), from 0. lists: name -> column.

    Tasks are dealt ``CELLS`` cells each, however many there are: by feature to meet the places, then by the key, or by ``within``, a column of the
    key whose rows shall stay together. Places of features that many rows have go to all tasks. places may hold n, how often each feature
    occurs; it deals rows out, results don't depend on it."""
    keys = _names(key)
    cells = rows.select(*keys, F.posexplode(F.array(*(_clean(c) for c in lists.values()))).alias("_list", "_features")).select(*keys, "_list", F.explode("_features").alias("feature"))
    if "n" not in places.columns:
        places = places.join(cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "feature")
    total = places.agg(F.sum("n")).first()[0] or 0
    parts = total // CELLS + 1
    hot, rest = (places.filter(c).select("feature", "place") for c in (F.col("n") > total * HOT, F.col("n") <= total * HOT))
    met = cells.join(F.broadcast(hot.select("feature")), "feature", "left_anti").repartition(parts, "feature").join(rest.hint("shuffle_hash"), "feature")
    placed = cells.join(F.broadcast(hot), "feature").unionByName(met).select(*keys, "_list", F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("_bit"))
    bit = lambda k, n: F.bit_or(F.when(F.col("_list") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(n)
    return placed.repartition(parts, *([within] if within else keys)).groupBy(*keys, "word").agg(*(bit(k, n) for k, n in enumerate(lists)))


def packed_overlaps(bits: DataFrame, key: str | list[str], predicted: str, truths: list[str], removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """(key, one overlap a truth) from packed words: bits in both by bits in either. removed, added: (word, mask) to take out or put in;
    words that a row lacks are taken from added too."""
    none = F.lit(0).cast("long")
    words, more = bits.withColumn("_on", none), bits.sparkSession.range(1).select(none.alias("_more"))
    masks = lambda rules, name: rules.groupBy("word").agg(F.bit_or("mask").alias(name))
    if removed is not None:
        words = words.join(F.broadcast(masks(removed, "_off")), "word", "left").withColumn(predicted, F.col(predicted).bitwiseAND(F.bitwise_not(F.coalesce("_off", none)))).drop("_off")
    if added is not None:
        on = masks(added, "_on")
        words = words.drop("_on").join(F.broadcast(on), "word", "left").withColumn("_on", F.coalesce("_on", none)).withColumn(predicted, F.col(predicted).bitwiseOR(F.col("_on")))
        more = on.agg(F.coalesce(F.sum(F.bit_count("_on")), none).alias("_more"))
    both = [F.sum(F.bit_count(F.col(predicted).bitwiseAND(F.col(t)))).alias(f"_both{k}") for k, t in enumerate(truths)]
    either = [F.sum(F.bit_count(F.col(predicted).bitwiseOR(F.col(t)))).alias(f"_either{k}") for k, t in enumerate(truths)]
    # of the added bits, those in words that the row lacks are in the union alone
    sums = words.groupBy(*_names(key)).agg(*both, *either, F.sum(F.bit_count("_on")).alias("_met")).crossJoin(F.broadcast(more))  # one row
    return sums.select(*_names(key), *(_overlap(F.col(f"_both{k}"), F.col(f"_either{k}") + F.col("_more") - F.col("_met")).alias(t) for k, t in enumerate(truths)))
