"""Operator 5, personal data by information-theoretic sanitisation. DataFrame expressions only.

Protected entities are the values of e-mail addresses, IP addresses, payment cards and phone numbers found in the
corpus (base spans). A term (a word of letters) reveals an entity e to the degree

    PMI(e; t) = log p(e | t) / p(e),    disclosed if its lower bound >= IC(e) / alpha,    IC(e) = -log p(e)

(a term that says as much of e as e itself has PMI = IC; the bound takes Wilson's lower bound of p(e | t), so few texts say
little). All shares are of distinct texts of the whole corpus, and a text is no evidence about itself: what a term reveals in one text is what the other texts say, so each
count is less by one (leave-one-out), the number of texts too. Words that share one text with an entity and no other
reveal nothing, however rare; copies of a text are one text. Nor do near copies bear witness for each other: where the
disclosing terms of an entity come to more than MOST_TERMS and MOST_SHARE of the terms that its texts have on average, some of those are
versions of one text, and all its terms are counted anew by weights: a text that has most of its telling terms in common with
k texts of the entity counts as one k-th, so that versions come to one witness and other texts to one each (see _weighed). Words
of the entity itself aren't counted. Disclosing terms are taken in every document that holds their entity, wherever they stand in it.

Redaction replaces base values by their kind. A disclosing term whose PMI stays below IC is generalised (to [TERM]);
one that gives the entity away entirely (PMI >= IC) is removed.

Spans are found by regular expressions: extract_all gives the matches, split the texts between, running lengths the
offsets in code points. Possessive forms with \\G or a look-behind find just what the plain leftmost patterns
do, without their quadratic retries inside a run of characters.

Defined cases: null text is empty and has no spans. Rows count one by one, whatever their ids, nulls included; repeated
rows stay repeated. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test of what every match contains, so that most texts are read once.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
WORD = r"\p{L}++"
#: Alpha; the quantile of the lower bound; letters of a term at least.
ALPHA, Z, LEAST_LETTERS = 1.5, 1.645, 3
#: Beyond so many disclosing terms, and such a share of its texts' terms, an entity's texts are counted by weights.
MOST_TERMS, MOST_SHARE = 3, 0.05


def _spans(text: Column, pattern: Column, kind: Column) -> Column:
    """[(kind, s, e, value)] of all matches of a pattern, which matches no empty string."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    rest = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(rest, F.lit(1), F.size(found)), found, lambda r, m: F.struct(F.length(r).alias("gap"), m.alias("m")))
    row = "array<struct<kind:string,s:int,e:int,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(kind.alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("value")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(row).alias("out")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The check sum over every digit, each second one from the right doubled."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the valid base spans of a text in order of their start."""
    empty = F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>")
    hint = lambda k: F.contains(text, F.lit("@")) if k == "email" else text.rlike(HINTS[k])

    def valid(kind: str) -> Column:
        return F.filter(_spans(text, F.lit(PATTERNS[kind]), F.lit(kind)), lambda x: _valid(kind, x["value"]))

    return {k: F.when(hint(k), valid(k)).otherwise(empty) for k in BASE}


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, email, ip, card, phone, text): spans by kind; text only where there are any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_kind = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    some = F.size(F.concat(*BASE)) > 0
    return by_kind.withColumn("text", F.when(some, F.col("text")))


def _term(word: Column) -> Column:
    return F.lower(word)


def _terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _term), lambda w: F.length(w) >= LEAST_LETTERS))


def _most(n_e: Column, n: Column, alpha: float) -> Column:
    """The n_t - 1 beyond which no term discloses an entity of n_e texts: PMI - IC = log((n_et - 1) / (n_t - 1)) and n_et <= n_e."""
    return F.pow(n_e - 1, F.lit(1 / alpha)) * F.pow(n - 1, F.lit(1 - 1 / alpha)) * (1 + 1e-9)


def _told(joint: DataFrame, alpha: float) -> DataFrame:
    """(entity, term, pmi, ic) of the rows (entity, term, n_e, n_t, n, n_et) that disclose."""
    less = lambda c: F.col(c) - 1.0
    share, z = less("n_et") / less("n_t"), Z / F.sqrt(less("n_t"))
    sure = (share + z * z / 2 - z * F.sqrt(share * (1 - share) + z * z / 4)) / (1 + z * z)  # Wilson's lower bound
    ic = F.log(less("n") / less("n_e"))
    return joint.select("entity", "term", (ic + F.log(share)).alias("pmi"), ic.alias("ic"), sure.alias("sure")).filter((F.col("ic") + F.log("sure")) * alpha >= F.col("ic")).drop("sure")


def _weighed(each: DataFrame, of_entity: DataFrame, of_term: DataFrame, total: DataFrame, alpha: float) -> DataFrame:
    """each (entity, k, term): all terms of all texts of some entities -> (entity, term, n_e, n_t, n, n_et), each text counted by its weight.

    Telling terms are those rare enough to disclose the entity at all. Each is in so many of its texts, less those that chance
    puts there; a text's weight is one by the median of these numbers over its telling terms. In n_t and n the entity's texts
    count by weight too. A term whose texts weigh less than two has no witness. Since a weight is at most 1, what is beyond the
    bound by plain counts is beyond it by weight (Hoelder's inequality)."""
    counts = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_et")).join(of_term, "term", "left").join(of_entity, "entity").withColumn("n", total.scalar())
    n_t = F.coalesce("n_t", F.lit(1)).cast("double")
    telling = counts.select("entity", "term", "c_et", F.col("n_e").alias("c_e"), n_t.alias("c_t"), F.col("n").alias("c")).filter(F.col("c_t") - 1 <= _most(F.col("c_e"), F.col("c"), alpha))
    rows = written(each.join(telling, ["entity", "term"]), "telling")
    common = F.greatest(F.lit(1.0), F.col("c_et") - (F.col("c_e") - 1) * (F.col("c_t") - 1) / (F.col("c") - 1))
    weights = written(rows.groupBy("entity", "k").agg((1 / F.percentile(common, 0.5)).alias("w")), "weights")
    # texts without a telling term count whole
    weight_of = weights.groupBy("entity").agg(F.sum("w").alias("w_e"), F.count(F.lit(1)).alias("texts"))
    by_term = rows.join(weights, ["entity", "k"]).groupBy("entity", "term", "c_et", "c_e", "c_t", "c").agg(F.sum("w").alias("n_et")).filter(F.col("n_et") >= 2 - 1e-9).join(weight_of, "entity")
    lost = F.col("texts") - F.col("w_e")
    return by_term.select("entity", "term", (F.col("c_e") - lost).alias("n_e"), (F.col("c_t") - F.col("c_et") + F.col("n_et")).alias("n_t"), (F.col("c") - lost).alias("n"), "n_et")


def disclosures(docs: DataFrame, found: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(entity, term, pmi, ic) of the terms that disclose an entity. found: rows of find_base that hold spans."""
    once = lambda df, text: df.withColumn("_th", F.xxhash64(text)).dropDuplicates(["_th"])
    entities = F.array_distinct(F.transform(F.concat(*BASE), lambda x: F.concat_ws(":", x["kind"], x["value"])))
    held = written(once(found, "text").select(F.monotonically_increasing_id().alias("k"), entities.alias("entities"), "text", F.size(_terms(F.col("text"))).alias("m")), "held")
    # what one text alone holds has no other text to say anything of it, so it is left out before entities meet terms
    of_entity = written(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter("n_e > 1"), "entities")
    texts = once(docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")), "text")
    of_term = written(texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter("n_t > 1"), "terms")
    total = docs.filter(F.col(text_col).isNotNull()).agg(F.count_distinct(F.xxhash64(text_col)).alias("n"))
    top = of_entity.agg(F.coalesce(F.max("n_e"), F.lit(2)).alias("n_e"))
    rare = of_term.withColumn("n", total.scalar()).withColumn("top", top.scalar()).filter(F.col("n_t") - 1 <= _most(F.col("top"), F.col("n"), alpha)).select("term", "n_t", "n")
    shared = held.select("k", "m", F.explode("entities").alias("entity")).join(of_entity, "entity")
    terms = held.join(shared.select("k").distinct(), "k", "left_semi").select("k", F.explode(_terms(F.col("text"))).alias("term")).join(rare, "term")
    joint = terms.join(shared.drop("m"), "k").filter(~F.contains(F.lower("entity"), F.col("term"))).groupBy("entity", "term", "n_e", "n_t", "n").agg(F.count(F.lit(1)).alias("n_et")).filter("n_et > 1")
    told = written(_told(joint, alpha), "told")
    # texts that have most of their words in common are versions of one text, not witnesses
    usual = shared.groupBy("entity").agg(F.avg("m").alias("m"))
    versions = written(told.groupBy("entity").agg(F.count(F.lit(1)).alias("d")).join(usual, "entity").filter(F.col("d") > F.greatest(F.lit(MOST_TERMS), MOST_SHARE * F.col("m"))).select("entity"), "versions")
    if versions.isEmpty():
        return told
    own = shared.select("k", "entity").join(versions, "entity")
    each = held.join(own, "k").select("entity", "k", F.explode(_terms(F.col("text"))).alias("term")).filter(~F.contains(F.lower("entity"), F.col("term")))
    again = _told(_weighed(written(each, "again"), of_entity, of_term, total, alpha), alpha)
    return told.join(versions, "entity", "left_anti").unionByName(again)


def _placed(texts: DataFrame) -> DataFrame:
    """texts (row, text) -> (row, s, e, word) of all their words. Offsets are running lengths over a text's words, laid out as
    rows: within one row, an array that grows word by word would cost the square of the text."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, WORD, -1), F.lit(1), F.size(words)), words, lambda r, w: F.struct(F.length(r).alias("gap"), w.alias("word")))
    laid = texts.select("row", F.posexplode(pairs).alias("k", "x")).select("row", "k", "x.gap", "x.word")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("row").orderBy("k")).cast("int")
    return laid.withColumn("e", end).select("row", (F.col("e") - F.length("word")).alias("s"), "e", "word")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(id, email, ip, card, phone, term, removed_term, text): all spans by kind; text only where there are any."""
    found = written(find_base(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "base")
    some = found.filter("text is not null")
    revealed = disclosures(docs, some, text_col, alpha)
    held = some.select("row", F.explode(F.concat(*BASE)).alias("x")).select("row", F.concat_ws(":", "x.kind", "x.value").alias("entity")).distinct()
    told = written(held.join(revealed, "entity").groupBy("row", "term").agg(F.max(F.col("pmi") >= F.col("ic") - 1e-9).alias("whole")), "disclosed")
    words = _placed(some.select("row", "text").join(told.select("row").distinct(), "row", "left_semi")).withColumn("term", _term(F.col("word")))
    span = lambda kind: F.struct(F.lit(kind).alias("kind"), "s", "e", F.col("word").alias("value"))
    of = lambda kind, test: F.array_sort(F.collect_list(F.when(test, span(kind)))).alias(kind)
    terms = words.join(told, ["row", "term"]).groupBy("row").agg(of("term", ~F.col("whole")), of("removed_term", F.col("whole")))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>")
    free = lambda x: ~F.exists(F.concat(*BASE), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    with_terms = some.join(terms, "row", "left").select("id", *BASE, *(F.filter(F.coalesce(k, none), free).alias(k) for k in ("term", "removed_term")), "text")
    return found.filter("text is null").select("id", *BASE, none.alias("term"), none.alias("removed_term"), "text").unionByName(with_terms)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced: by its kind in brackets, or by nothing for removed terms. Overlaps join."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["kind"] == "removed_term", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), mark)
        inside = x["s"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    return F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts redacted; documents without spans keep theirs, nulls included."""
    row, clean = unused(docs, "row", "clean")
    found = find(docs, id_col, text_col).filter("text is not null")
    some = found.select(F.struct("id", F.xxhash64("text").alias("th")).alias(row), redacted(F.col("text"), F.concat(*BASE, "term", "removed_term")).alias(clean))
    some = some.groupBy(row).agg(F.first(clean).alias(clean))
    keyed = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")))  # equal structs have equal or no ids
    return keyed.join(some, row, "left").select(*(F.coalesce(clean, c).alias(c) if c == text_col else F.col(c) for c in docs.columns))
