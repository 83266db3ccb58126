"""Weighted multi-criteria ranking, lexical relevance and rank fusion.

Criteria are a query, so they compile into one column: a ranking is a scan, a projection and a top-k, without a
shuffle of the catalogue.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"must": 1.6, "strong_prefer": 1.3, "prefer": 1.0, "avoid": 0.0}


@dataclass(frozen=True)
class Criterion:
    """A value the user wants, and the terms that stand for it: (term, factor)."""

    value: str
    fields: tuple[str, ...]
    terms: tuple[tuple[str, float], ...]
    weight: float = 1.0
    priority: str = "prefer"

    @property
    def boost(self) -> float:
        return self.weight * PRIORITY[self.priority]

    @property
    def attainable(self) -> float:
        return self.boost * max((f for _, f in self.terms), default=0.0)


@dataclass(frozen=True)
class Signals:
    """Field -> weight of log10(1 + field); their sum is capped."""

    weights: dict[str, float] = field(default_factory=dict)
    cap: float = 3.0


def _matches(df: DataFrame, name: str, term: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.coalesce(F.array_contains(name, term) if kind == "array" else F.col(name) == term, F.lit(False))


def match_score(df: DataFrame, c: Criterion) -> Column:
    """The best of a value's terms over its fields, 0 if none matches."""
    scores = [F.when(_matches(df, f, t), F.lit(c.boost * k)).otherwise(F.lit(0.0)) for t, k in c.terms for f in c.fields]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def rank(df: DataFrame, criteria: list[Criterion], signals: Signals | None = None, where: Column | None = None, minimum: int = 1, k: int = 10, key: str = "model_id", excluded: list[Criterion] | None = None) -> DataFrame:
    """Top k by the sum of each value's best match and of the capped signals; ties by key. Documents that match fewer than
    ``minimum`` values, fail ``where`` or match an excluded value don't count. Also display_score, of 100."""
    docs = df if where is None else df.filter(where)
    for c in excluded or []:
        docs = docs.filter(~reduce(lambda a, b: a | b, [_matches(docs, f, t) for t, _ in c.terms for f in c.fields]))
    scores = [match_score(docs, c) for c in criteria]
    matched = sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))
    best = sum(scores, F.lit(0.0))
    signal = sum((F.lit(w) * F.log10(1 + F.coalesce(F.col(n), F.lit(0))) for n, w in (signals.weights if signals else {}).items()), F.lit(0.0))
    full = sum(c.attainable for c in criteria) or 1.0
    out = docs.withColumn("n_matched", matched).filter(F.col("n_matched") >= minimum)
    out = out.withColumn("match_score", best).withColumn("score", F.col("match_score") + F.least(signal, F.lit(signals.cap if signals else 0.0)))
    return out.withColumn("display_score", 100 * F.col("match_score") / full).orderBy(F.desc("score"), key).limit(k)


def explain(df: DataFrame, criteria: list[Criterion], key: str = "model_id") -> DataFrame:
    """(key, value, term, field, contribution): every match, best marks the one that counts for its value."""
    parts = [F.struct(F.lit(c.value).alias("value"), F.lit(t).alias("term"), F.lit(f).alias("field"), F.when(_matches(df, f, t), F.lit(c.boost * k)).otherwise(F.lit(0.0)).alias("contribution")) for c in criteria for t, k in c.terms for f in c.fields]
    rows = df.select(key, F.explode(F.filter(F.array(*parts), lambda x: x["contribution"] > 0)).alias("x")).select(key, "x.*")
    w = Window.partitionBy(key, "value").orderBy(F.desc("contribution"), "term", "field")
    return rows.withColumn("best", F.row_number().over(w) == 1)


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 60, key: str = "model_id") -> DataFrame:
    """Reciprocal rank fusion: rankings (key, rank) with weights -> (key, score) by the sum of weight / (k + rank)."""
    parts = [r.groupBy(key).agg(F.min("rank").alias("rank")).select(key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for r, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The top k with their rank. The window runs over k rows only."""
    return df.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75, must_not: list[str] | None = None) -> DataFrame:
    """(id, score) of documents that hold a term (lower-cased words between white space). Counts are what a text loses when the
    term is replaced by nothing, so no words are split off; scores look only at texts that contain a term's letters."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text_col), r"[\t\n\r\x0b\x0c]", " "), F.lit(" "))
    plain = docs.select(id_col, low.alias("_low"))

    def times(term: str) -> Column:
        own = f" {term} "
        return ((F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", F.lit(own), F.lit("")))) / len(own.encode())).cast("long")

    size = F.regexp_count("_low", F.lit("[^ ]+"))
    has = lambda t: F.contains("_low", F.lit(f" {t} "))
    stats = plain.agg(F.count(F.lit(1)).alias("_n"), F.avg(size).alias("_avg"), *(F.count_if(has(t)).alias(f"_df{i}") for i, t in enumerate(terms)))
    space = r"[ \t\n\r\x0b\x0c]"
    holds = lambda words: F.lower(text_col).rlike(rf"(?:^|{space})(?:{'|'.join(map(re.escape, words))})(?:$|{space})")
    some = docs.filter(holds(terms))  # so every score is above 0
    some = some.filter(~holds(must_not)) if must_not else some
    some = some.select(id_col, low.alias("_low"))
    some = some.select(id_col, "_low", F.replace("_low", F.lit(" "), F.lit("  ")).alias("_spaced"))  # each word has spaces of its own
    counted = some.select(id_col, size.alias("_len"), *(times(t).alias(f"_tf{i}") for i, t in enumerate(terms))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return counted.select(id_col, score.alias("score"))


def relax(df: DataFrame, hard: list[tuple[str, Column]], soft: list[tuple[str, Column]], target: int) -> tuple[int, list[dict]]:
    """Stage s drops the first s soft filters. All stages are counted in one pass; the first with ``target`` hits wins,
    else the one with most hits. (stage, counts by stage)."""
    base = reduce(lambda a, b: a & b, [c for _, c in hard], F.lit(True))
    stages = [reduce(lambda a, b: a & b, [c for _, c in soft[s:]], base) for s in range(len(soft) + 1)]
    row = df.agg(*(F.count_if(c).alias(f"s{i}") for i, c in enumerate(stages))).first()
    counts = [{"stage": i, "relaxed": [n for n, _ in soft[:i]], "hits": row[f"s{i}"]} for i in range(len(stages))]
    enough = [c["stage"] for c in counts if c["hits"] >= target]
    return (enough[0] if enough else max(counts, key=lambda c: (c["hits"], -c["stage"]))["stage"]), counts
