"""A user's intent, a bundle of structs, as weighted criteria, and rows ranked by such criteria.

A preference is a struct of include and exclude (lists of strings) and a priority. Its included values are one feature,
met by any of them; each functional item and each quality attribute is a feature of its own. The priority says how a
feature counts: must filters, strong_prefer filters until it is relaxed, prefer adds to the score, avoid excludes, as
excluded values do. What a bundle's schema lacks is left out.

Defined cases: null structs and lists have no criteria, null and blank values are none, repeated ones count once; a
priority that is null or unknown is the feature's default. An intent without criteria has no rows, and one
without an id finds none. Rows tie by their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import PRIORITY
from .rounds import kept

#: The clause of each priority.
CLAUSE = {"must": "filter", "strong_prefer": "relaxable", "prefer": "should", "avoid": "must_not"}

#: Most intents and rows of a slot; of either, where all that match are returned. Scores that a task has before it at once.
BLOCK, ROWS, PAIRS, CELLS = 4096, 8192, 512, 1 << 18


class Feature(NamedTuple):
    """Where a bundle holds a preference, the field that its values are looked for in, its weight and default priority."""

    name: str
    path: str
    field: str
    weight: float = 1.0
    priority: str = "prefer"


#: Features of a whole bundle; aliases are weaker than what they stand for.
FEATURES = (
    Feature("task", "essential.task", "task", 8.0),
    Feature("task_alias", "essential.task_aliases", "task", 8.0 * 0.85, "strong_prefer"),
    Feature("domain", "essential.domain", "domain", 2.0),
    Feature("author", "essential.author", "author"),
    Feature("objective", "essential.objective", "objective"),
    Feature("domain_alias", "essential.domain_aliases", "domain", 2.0 * 0.9, "strong_prefer"),
    *(Feature(name, f"preferences.{name}", name) for name in ("license_name", "library_name", "basemodels", "datasets", "language", "metrics", "gated")),
    Feature("last_modified", "preferences.last_modified", "last_modified_year", 0.0, "must"),
)


def _has(schema: T.StructType, path: str) -> bool:
    name, _, rest = path.partition(".")
    kind = next((f.dataType for f in schema.fields if f.name == name), None)
    return kind is not None and (not rest or (isinstance(kind, T.StructType) and _has(kind, rest)))


def _rows(values: Column, feature: Column | None, field: str, clause: Column, weight: Column) -> Column:
    """A struct for each distinct value of a list; without a feature each value is its own."""
    own = F.filter(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.length(F.trim(v)) > 0)
    return F.transform(own, lambda v: F.struct((F.concat(F.lit("functional:"), v) if feature is None else feature).alias("feature"), F.lit(field).alias("field"), v.alias("value"), clause.alias("clause"), F.round(weight, 4).alias("weight")))


def criteria(bundles: DataFrame, id_col: str, features: tuple[Feature, ...] = FEATURES, functional: tuple[str, str, float] = ("functional.items", "features", 1.0), quality: dict[str, float] | None = None) -> DataFrame:
    """(id, feature, field, value, clause, weight) of every bundle.

    functional: the path of a list of items, their field and weight. quality: attributes of the struct quality, whose values
    are looked for in the field of their name, and their weights.
    """
    parts, should = [], F.lit(CLAUSE["prefer"])
    for f in features:
        if not _has(bundles.schema, f.path):
            continue
        own = F.col(f"{f.path}.priority") if _has(bundles.schema, f"{f.path}.priority") else F.lit(None)
        priority = F.when(own.isin(*CLAUSE), own).otherwise(F.lit(f.priority))
        clause = reduce(lambda c, p: c.when(priority == p, F.lit(CLAUSE[p])), list(CLAUSE)[1:], F.when(priority == "must", F.lit(CLAUSE["must"])))
        times = reduce(lambda c, p: c.when(priority == p, F.lit(PRIORITY[p])), list(CLAUSE)[1:], F.when(priority == "must", F.lit(PRIORITY["must"])))
        parts.append(_rows(F.col(f"{f.path}.include"), F.lit(f.name), f.field, clause, times * F.lit(f.weight)))
        if _has(bundles.schema, f"{f.path}.exclude"):
            parts.append(_rows(F.col(f"{f.path}.exclude"), F.lit(f.name), f.field, F.lit(CLAUSE["avoid"]), F.lit(0.0)))
    path, field, weight = functional
    if _has(bundles.schema, path):
        parts.append(_rows(F.col(path), None, field, should, F.lit(weight)))
    for name, w in (quality or {}).items():
        if _has(bundles.schema, f"quality.{name}"):
            parts.append(_rows(F.array(F.col(f"quality.{name}").cast("string")), F.lit(name), name, should, F.lit(w)))
    row = "array<struct<feature:string,field:string,value:string,clause:string,weight:double>>"
    return bundles.select(id_col, F.explode(F.flatten(F.array(*parts)) if parts else F.array().cast(row)).alias("c")).select(id_col, "c.*")


def classes(wanted: DataFrame, id_col: str) -> DataFrame:
    """(id, class): intents with the same criteria share the smallest of their ids, so that each is searched for once.

    A group is one bundle's criteria."""
    same = wanted.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("feature", "field", "value", "clause", "weight"))).alias("all"))
    key = same.select(id_col, F.sha2(F.to_json("all"), 256).alias("key"))
    return key.join(key.groupBy("key").agg(F.min(id_col).alias("class")), "key").select(id_col, "class")


def _codes(wanted: DataFrame) -> DataFrame:
    """(field, value, code, part): a number for each wanted value, and one for its field. Fields that share a number are taken together, no more."""
    distinct = wanted.select("field", "value").filter("value is not null").distinct()
    return kept(distinct.select("field", "value", F.monotonically_increasing_id().alias("code"), F.pmod(F.xxhash64("field"), F.lit(1 << 20)).cast("int").alias("part")), "codes")


def _sets(values: DataFrame, codes: DataFrame, row_col: str) -> DataFrame:
    """(row, items): the wanted values that a row holds, sorted; rows without any are left out."""
    held = values.select(row_col, "field", "value").join(codes, ["field", "value"])
    return held.groupBy(row_col).agg(F.sort_array(F.collect_set(F.struct("part", "code"))).alias("items"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """The structs of a column of lists, and the row of each."""
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _numbers(column: pa.Array) -> np.ndarray:
    """Equal values have equal numbers, null -1."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Part(NamedTuple):
    """Fields that no feature links with others: each row's set of values there, and by value the sets that hold it."""

    set_of_row: np.ndarray
    sets: int
    start: np.ndarray
    count: np.ndarray
    held_by: np.ndarray


def _part_of(rows: int, row: np.ndarray, code: np.ndarray, codes: int) -> _Part:
    """row, code: what rows hold in the part, sorted by both; codes up to ``codes``."""
    ends = np.searchsorted(row, np.arange(rows + 1))
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(code[i:j].tobytes(), len(known)) for i, j in zip(ends[:-1], ends[1:])], np.int64)
    members = [np.frombuffer(x, np.int64) for x in known]
    sets, held = np.repeat(np.arange(len(members)), [len(m) for m in members]), np.concatenate([np.zeros(0, np.int64), *members])
    order = np.argsort(held, kind="stable")
    count = np.bincount(held, minlength=codes)
    return _Part(of, len(members), np.cumsum(count) - count, count, sets[order])


def _linked(group: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """By part the smallest of those that a group of criteria links it with."""
    root = np.arange(parts)
    pairs = np.unique(np.stack([group, part], 1), axis=0)
    same = pairs[1:][pairs[1:, 0] == pairs[:-1, 0]], pairs[:-1][pairs[1:, 0] == pairs[:-1, 0]]
    links = np.unique(np.stack([same[0][:, 1], same[1][:, 1]], 1), axis=0)
    while len(links):
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        before = root.copy()
        np.minimum.at(root, links[:, 0], low)
        np.minimum.at(root, links[:, 1], low)
        if (before == root).all():
            break
    return root


def _cell(asked: pa.ChunkedArray, items: pa.ChunkedArray, strict: list[str], least: int, k: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(intent, row, score, n_should) by places in asked (criteria of each intent) and items (of each row, in order of their ids).

    An intent's score, filters and exclusions are worked out for each set of values that a part's rows hold, of which there are few;
    a row's are the sum of its sets'."""
    intent, c = _flat(asked)
    row, v = _flat(items)
    intents, rows = len(asked), len(items)
    clause, feature = c.field("clause"), _numbers(c.field("feature"))
    binding = pc.is_in(clause, pa.array(strict)).to_numpy(zero_copy_only=False)
    barring = pc.equal(clause, "must_not").to_numpy(zero_copy_only=False)
    weight = c.field("weight").to_numpy(zero_copy_only=False)
    width = int(feature.max(initial=0)) + 2
    needed = np.bincount(np.unique((intent * width + feature + 1)[binding & (feature >= 0)]) // width, minlength=intents)
    codes, code = np.unique(v.field("code").to_numpy(zero_copy_only=False), return_inverse=True)
    if not len(codes):
        return
    want = pc.fill_null(c.field("code"), -1).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
    met = codes[at] == want
    if not met.any():
        return
    group = ((intent * width + feature + 1) * 2**20 + _numbers(clause))[met]
    groups, group = np.unique(group, return_inverse=True)
    at, weight, intent, binding, barring = at[met], weight[met], intent[met], binding[met], barring[met]
    own = np.zeros((3, len(groups)), np.int64)
    own[0][group], own[1][group] = intent, np.where(barring, 1 << 40, np.where(binding, 1, 1 << 20))
    own[2][group] = ~barring
    names, part = np.unique(v.field("part").to_numpy(zero_copy_only=False), return_inverse=True)
    part_of_code = np.zeros(len(codes), np.int64)
    part_of_code[code] = part
    part_of_code = _linked(group, part_of_code[at], len(names))[part_of_code]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    parts = {p: _part_of(rows, row[m], code[m], len(codes)) for p in np.unique(part_of_code) for m in [part_of_code[code] == p]}
    some = max(1, CELLS // max(1, rows))
    ends = np.searchsorted(intent, np.arange(0, intents + some, some))  # criteria come in order of their intents
    for first, i, j in zip(range(0, intents, some), ends[:-1], ends[1:]):
        n = min(some, intents - first)
        score, state = np.zeros((n, rows)), np.zeros((n, rows), np.int64)
        for p, has in parts.items():
            mine = np.flatnonzero(part_of_code[at[i:j]] == p) + i
            times = has.count[at[mine]]
            which = np.repeat(mine, times)
            if not len(which):
                continue
            sets = has.held_by[np.repeat(has.start[at[mine]] - (np.cumsum(times) - times), times) + np.arange(len(which))]
            key = group[which] * has.sets + sets
            by_key = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[by_key], prepend=-1))
            best_weight = np.maximum.reduceat(weight[which][by_key], begins)
            key = key[by_key][begins]
            g = key // has.sets
            cell = (own[0][g] - first) * has.sets + key % has.sets
            gain = np.bincount(cell, np.where(own[2][g] == 1, best_weight, 0.0), n * has.sets).reshape(n, -1)
            step = np.bincount(cell, own[1][g].astype(float), n * has.sets).astype(np.int64).reshape(n, -1)
            score += np.take(gain, has.set_of_row, axis=1)
            state += np.take(step, has.set_of_row, axis=1)
        n_should = (state >> 20) & 0xFFFFF
        good = (state > 0) & (state - (n_should << 20) == needed[first : first + n, None]) & (n_should >= least)
        points = np.copysign(np.floor(np.abs(score) * 1e4 + 0.5), score) + 0.0
        if k is not None and rows > k:
            place = np.where(good, points.astype(np.int64) * rows + np.arange(rows - 1, -1, -1), np.iinfo(np.int64).min)
            good &= place >= np.partition(place, rows - k, axis=1)[:, rows - k, None]
        x, y = np.nonzero(good)
        yield x + first, y, points[x, y] / 1e4, n_should[x, y]


def matches(values: DataFrame, wanted: DataFrame, id_col: str, row_col: str, relaxed: bool = False, least: int = 0, k: int | None = None) -> DataFrame:
    """(id, row, score, n_should) of the rows that every filter of an intent lets pass and that none of its exclusions meets.

    values: (row, field, value), a line for each value that a row holds. A row needs a hit of some kind, so values meet criteria
    by equality alone; relaxed takes the relaxable filters as preferences, least is how many preferences must be met. A
    feature's best value counts; a null weight is 0, a criterion without a clause is none. With k only rows are
    returned that can be among an intent's k best, k of each slot. Intents and rows are dealt into slots, each pair of slots is a group
    that a task counts out by itself.
    """
    strict = ["filter"] if relaxed else ["filter", "relaxable"]
    spark = values.sparkSession
    codes = _codes(wanted)
    criterion = F.struct("feature", "clause", F.coalesce("weight", F.lit(0.0)).alias("weight"), "code")
    asked = wanted.filter(F.col(id_col).isNotNull() & F.col("clause").isNotNull()).join(codes, ["field", "value"], "left")
    asked = kept(asked.groupBy(id_col).agg(F.collect_list(criterion).alias("asked")), "asked")
    rows = kept(_sets(values, codes, row_col), "rows")
    ids, n = asked.count(), rows.count()
    slots = -(-n // (ROWS if k is not None else PAIRS)) or 1
    of_slot = min(BLOCK if k is not None else PAIRS, -(-ids * slots // (4 * spark.sparkContext.defaultParallelism)) or 1)
    id_slots = -(-ids // of_slot) or 1
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    keys, tasks = ["id_slot", "slot"], min(slots * id_slots, 32 * spark.sparkContext.defaultParallelism)
    left = asked.select(deal(id_col, id_slots).alias("id_slot"), every(slots).alias("slot"), id_col, "asked").repartition(tasks, *keys)
    right = rows.select(deal(row_col, slots).alias("slot"), every(id_slots).alias("id_slot"), row_col, "items").repartition(tasks, *keys)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            b = b.take(pc.sort_indices(b.column(row_col), null_placement="at_start"))
            found = list(_cell(a.column("asked"), b.column("items"), strict, least, k))
        x, y, score, n_should = (np.concatenate(part) for part in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([a.column(id_col).take(pa.array(x)), b.column(row_col).take(pa.array(y)), pa.array(score, pa.float64()), pa.array(n_should, pa.int64())], names=[id_col, row_col, "score", "n_should"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"`{id_col}` {kind(asked, id_col)}, `{row_col}` {kind(rows, row_col)}, score double, n_should long")


def best(found: DataFrame, id_col: str, row_col: str, k: int) -> DataFrame:
    """The k best rows of each intent with their place; only k rows of an intent leave a task."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), row_col)).cast("long")
    return found.withColumn("place", place).filter(F.col("place") <= k)


def ranked(values: DataFrame, wanted: DataFrame, id_col: str, row_col: str, k: int, relaxed: bool = False, least: int = 0) -> DataFrame:
    """best of matches, exactly, but each class of intents meets each profile of wanted values once.

    Rows that hold the same wanted values share the smallest of their ids as profile and have one score, so k profiles, in the order of
    their first rows, hold the k best rows, and of each no more than its k first rows are among them."""
    class_of = kept(classes(wanted.filter(F.col(id_col).isNotNull()), id_col), "classes")
    of_class = wanted.join(class_of.filter(F.col(id_col) == F.col("class")).select(id_col), id_col, "left_semi")
    codes = _codes(wanted)
    sets = kept(_sets(values, codes, row_col), "sets")
    of_set = kept(sets.groupBy("items").agg(F.min(row_col).alias("profile")), "profiles")
    of_profile = of_set.select(F.col("profile").alias(row_col), F.explode("items.code").alias("code")).join(codes, "code").select(row_col, "field", "value")
    found = best(matches(of_profile, of_class, id_col, row_col, relaxed, least, k), id_col, row_col, k).drop("place").withColumnRenamed(row_col, "profile")
    place = F.row_number().over(Window.partitionBy("profile").orderBy(row_col))
    firsts = sets.join(of_set, "items").select(row_col, "profile").withColumn("_at", place).filter(F.col("_at") <= k).drop("_at")
    top = best(found.join(firsts, "profile").select(F.col(id_col).alias("class"), row_col, "score", "n_should"), "class", row_col, k)
    return class_of.join(top, "class").select(id_col, row_col, "score", "n_should", "place")
