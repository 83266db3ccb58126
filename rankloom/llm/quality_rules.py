"""Operator 7, quality rules: a decision list learned by sequential covering.

text_statistics   counts per text, in one Arrow pass over whole texts
ratios            the list's features, as Spark columns over those counts
learn_rules       sequential covering: grow a conjunction of thresholds by information gain on two thirds of the
                  labelled rows, prune it on the rest, keep it if it is precise enough there, go on with the rows
                  it leaves
rule_column       the ordered list as one CASE WHEN expression

Defined cases: a null or empty text has no words, all counts are zero and it fails the base rule. Repeated rows are
judged alike. An empty table gives an empty result. No usable labels give no rules, so the base rule alone decides.
Columns other than the id and the text are not read, but accepted() returns them all, whatever their names. A null id never
meets a label. Of several labels of an id the largest counts. Ties between thresholds go to the first feature, the lowest value.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_share, texts_of, written

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
UPPER = bytes(range(65, 91))
NOT_MARKS = bytes(range(48, 58)) + UPPER + bytes(range(97, 123)) + SPACES.encode() + bytes(range(128, 256))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_lines"]
#: Labelled rows that training gathers on the driver at most, about (chosen by the hash of their id).
MAX_TRAINING_ROWS = 20_000
Condition = tuple[str, str, float]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered[i : i + size] = b"\1" * size
    return sum(covered)


def counts_of(text: str) -> tuple[int, ...]:
    """COUNTS of a text. bytes.split() splits at exactly space and \\x09-\\x0D."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        without(SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        without(UPPER),
        without(b"0123456789"),
        len(raw.translate(None, NOT_MARKS)),
        len(lines),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns in keep) with COUNTS of each whole text."""
    kept = [id_col, *(keep or [])]
    schema = [f for f in docs.schema.fields if f.name in kept]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counts_of(t) for t in texts_of(batch, text_col)]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*(f.name for f in schema), *COUNTS])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{c} bigint" for c in COUNTS)])
    return arrow_map(docs.select(*dict.fromkeys([*(f.name for f in schema), text_col])), make, ddl)


def ratios() -> dict[str, Column]:
    """The features that rules may test."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / words,
    }


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, op, at in rule:
        v = x[:, names.index(name)]
        ok &= v >= at if op == ">=" else v < at
    return ok


def _best(v: np.ndarray, bad: np.ndarray, values: np.ndarray, base: float) -> tuple[float, str, float]:
    """(FOIL gain, operator, threshold) of the best of these thresholds."""
    order = np.argsort(v, kind="stable")
    all_below = np.searchsorted(v[order], values)  # rows and bad rows below each threshold
    bad_below = np.concatenate([[0], np.cumsum(bad[order])])[all_below]
    best = (1e-9, "", 0.0)
    for op, p, n in ((">=", bad.sum() - bad_below, len(v) - all_below), ("<", bad_below, all_below)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > 0, p * (np.log2(p / n) - base), 0.0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), op, float(values[int(gain.argmax())]))
    return best


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> list[Condition]:
    """Add the threshold of the largest FOIL gain, out of all values between rows, until the rule covers no good row or
    nothing gains. Thresholds on one side of one feature are one condition, the tightest."""
    rule: dict[tuple[str, str], float] = {}
    inside = np.ones(len(x), bool)
    while (p := (y & inside).sum()) and (~y & inside).any():
        base, best = np.log2(p / inside.sum()), (1e-9, None)
        for j, name in enumerate(names):
            v = np.unique(x[inside, j])
            gain, op, at = _best(x[inside, j], y[inside], (v[1:] + v[:-1]) / 2, base)
            if gain > best[0]:
                best = (gain, (name, op, at))
        if best[1] is None or best[1][:2] not in rule and len(rule) == most:
            break
        rule[best[1][:2]] = best[1][2]
        inside &= _holds(x, names, [best[1]])
    return [(*k, at) for k, at in rule.items()]


def _prune(x: np.ndarray, y: np.ndarray, names: list[str], rule: list[Condition], least: float) -> list[Condition]:
    """The rule without the conditions that add nothing to (p - n) / (p + n) on rows that didn't grow it, whichever they
    are; none at all if it is not precise enough there."""
    def worth(r: list[Condition]) -> float:
        c = _holds(x, names, r)
        return ((y & c).sum() - (~y & c).sum()) / max(c.sum(), 1)

    while len(rule) > 1:
        score, k = max((worth(rule[:k] + rule[k + 1 :]), k) for k in range(len(rule)))
        if score < worth(rule):
            break
        rule = rule[:k] + rule[k + 1 :]
    return rule if rule and (worth(rule) + 1) / 2 >= least else []


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str], precision: float = 0.97, max_rules: int = 12, max_conditions: int = 4, least_cover: int = 5, seed: int = 7) -> list[list[Condition]]:
    """Ordered conjunctions for y (bad rows). A rule below the precision on the pruning rows is not emitted, nor any after it."""
    rng = np.random.default_rng(seed)
    prune_on = rng.random(len(x)) < 1 / 3
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (y & left).sum() >= least_cover:
        g, p = left & ~prune_on, left & prune_on
        rule = _prune(x[p], y[p], names, _grow(x[g], y[g], names, max_conditions), precision)
        cover = _holds(x, names, rule) & left if rule else np.zeros(len(x), bool)
        if cover.sum() < least_cover or (y & cover).sum() < precision * cover.sum():
            break
        rules.append(rule)
        left &= ~cover
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bad: int = 0, max_rows: int = MAX_TRAINING_ROWS) -> list[list[Condition]]:
    """Rules from the labelled rows, of which about max_rows at most are gathered, chosen by the hash of their id."""
    features = ratios()
    marks = labels.select(F.col(id_col), F.col(label_col).alias("_label")).dropna()
    total = marks.count()
    chosen = marks.filter(hash_share(F.col(id_col), max_rows, total)).groupBy(id_col).agg(F.max("_label").alias("_label"))
    rows = stats.join(chosen, id_col).select("_label", *(c.alias(k) for k, c in features.items())).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the order of tasks must not matter
    return learn_rules(rows[list(features)].to_numpy(float), (rows["_label"] == bad).to_numpy(), list(features))


def rule_column(rules: list[list[Condition]]) -> Column:
    """The number (from 1) of the first rule that holds, 0 if none: an ordered CASE WHEN over the counts."""
    features = ratios()
    out = None
    for n, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, at in rule:
            test = test & (features[name] >= at if op == ">=" else features[name] < at)
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with base_failed, rule (0: none) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rule_column(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rule nor rules learned from their labels reject."""
    plain = docs.toDF(*(f"_{k}" for k in range(len(docs.columns))))  # no name of the table's own meets one of ours
    own = dict(zip(docs.columns, plain.columns))
    stats = written(text_statistics(plain, own[id_col], own[text_col], keep=plain.columns), "statistics")
    marks = labels.select(F.col(id_col).alias(own[id_col]), "quality")
    return judged(stats, fit_rules(stats, marks, own[id_col])).filter("kept").select(*(F.col(v).alias(k) for k, v in own.items()))
