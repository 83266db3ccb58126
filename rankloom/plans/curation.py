"""Queries that merge, align, filter and sample phrases and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import alignment, evaluation, sampling

from .catalogue import table
from .registry import query


@query("""WITH v AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents) GROUP BY w),
    m AS (SELECT r.w, arg_min(a.w, (-a.n, a.w)) AS anchor FROM v r JOIN v a ON a.n >= 20 AND r.n < 20 AND abs(length(a.w) - length(r.w)) <= 1 AND levenshtein(a.w, r.w) <= 1 GROUP BY r.w)
    SELECT coalesce(anchor, w) AS phrase, count(*) AS n_forms, sum(n)::BIGINT AS n FROM v LEFT JOIN m USING (w) GROUP BY 1""")
def phrase_fuzzy_merge(spark, d):
    """Rare words join the most frequent common word one edit away; words of 5 letters and more."""
    v = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    near = alignment.one_edit_apart(v.filter("n < 20").select("w"), v.filter("n >= 20").select("w"))
    best = near.join(v.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b").groupBy(F.col("a").alias("w")).agg(F.min_by("b", F.struct(-F.col("n_b"), F.col("b"))).alias("anchor"))
    return v.join(best, "w", "left").groupBy(F.coalesce("anchor", "w").alias("phrase")).agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n"))


def label_lists(spark, d):
    """The distinct words of a turn as predictions, those of the next turn as truth; whole texts."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    turns = table(spark, d, "conversations").select("conv_id", "turn", own.alias("labels"))
    return turns.toDF("conv_id", "turn", "predicted").join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("labels").alias("truth")), ["conv_id", "turn"])


@query()
def eval_one_to_one(spark, d):
    """Agreement of two label lists, aligned one to one. A null list gives nulls."""
    tp = F.size(alignment.aligned("predicted", "truth"))
    return evaluation.derived(label_lists(spark, d).select("conv_id", "turn", tp.alias("tp"), (F.size("predicted") - tp).alias("fp"), (F.size("truth") - tp).alias("fn")))


@query("""WITH c AS (SELECT lang, count(*) AS n, least(count(*), 20) AS base FROM documents WHERE lang IS NOT NULL GROUP BY lang),
    t AS (SELECT greatest(0, least(300, sum(n)) - sum(base))::BIGINT AS rest, sum(n - base)::BIGINT AS space FROM c),
    q AS (SELECT lang, base, rest * (n - base) // space AS part, rest, row_number() OVER (ORDER BY rest * (n - base) % space DESC, lang) AS nth FROM c, t),
    z AS (SELECT lang, base + part + (nth <= rest - (SELECT sum(part) FROM q))::INT AS quota FROM q),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents)
    SELECT doc_id, lang FROM r JOIN z USING (lang) WHERE r <= quota""")
def sample_quota(spark, d):
    """300 documents, 20 of each language at least, the rest in proportion: the size is the feature."""
    return sampling.quota_sample(table(spark, d, "documents").select("doc_id", "lang").filter("lang IS NOT NULL"), "lang", "doc_id", 300, 20)


@query()
def sample_rebalanced(spark, d):
    """200 documents over their sources: 5 of each at least, 15 if others can spare them; the sizes are the feature. Rounds have no SQL."""
    return sampling.rebalanced_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 200, 5, 15)


@query("""WITH a AS (SELECT 'customer' AS source, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, regexp_extract(c_name, '[0-9]+') AS digits FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, s_acctbal, regexp_extract(s_name, '[0-9]+') FROM supplier)
    SELECT coalesce(CASE WHEN balance >= 0 THEN 'id:' || digits END, 'nation:' || nation) AS key, min(name) AS name, round(max(balance), 2) AS balance, count(*) AS n, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM a GROUP BY 1""")
def record_key_merge(spark, d):
    """Records of two sources under the first key they have, merged field by field."""
    rows = lambda t, p, s: table(spark, d, t).select(F.lit(t).alias("source"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))
    a = rows("customer", "c", "customer").unionByName(rows("supplier", "s", "supplier"))
    key = F.coalesce(F.when(F.col("balance") >= 0, F.concat(F.lit("id:"), F.regexp_extract("name", "[0-9]+", 0))), F.concat(F.lit("nation:"), F.col("nation").cast("string")))
    return a.groupBy(key.alias("key")).agg(F.min("name").alias("name"), F.round(F.max("balance"), 2).alias("balance"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.min("source").alias("first_source"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(text, '[!-~]+')) AS w FROM documents), s AS (SELECT w, length(w) AS n, length(regexp_replace(w, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(w, '[0-9A-Za-z]', '', 'g')) AS symbols FROM t)
    SELECT CASE WHEN n < 3 THEN 'short' WHEN n > 50 THEN 'long' WHEN starts_with(w, '/') THEN 'path' WHEN digits >= 0.8 * n THEN 'digits' WHEN symbols >= 0.6 * n THEN 'symbols' ELSE 'kept' END AS reason, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM s GROUP BY 1""")
def phrase_drop_reasons(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[!-~]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    n, digits, symbols = F.length("w"), F.regexp_count("w", F.lit("[0-9]")), F.regexp_count("w", F.lit("[^0-9A-Za-z]"))
    reason = F.when(n < 3, "short").when(n > 50, "long").when(F.startswith("w", F.lit("/")), "path").when(digits >= 0.8 * n, "digits").when(symbols >= 0.6 * n, "symbols").otherwise("kept")
    return w.groupBy(reason.alias("reason")).agg(F.sum("k").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


@query(r"""WITH s AS (SELECT conv_id, turn, role, regexp_matches(text, '\b(def|class|import|return|function|select)\b') OR length(regexp_replace(text, '[^{}()\[\];=<>]', '', 'g')) > 10 AS code, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, role, code, len(w) > 0 AND len(list_filter(w, lambda x: x IN ('the', 'and', 'user', 'link', 'code'))) >= 0.9 * len(w) AS placeholders FROM s""")
def review_filters(spark, d):
    """Turns that look like code or hold little but placeholders."""
    c = table(spark, d, "conversations").filter("text IS NOT NULL").withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    code = F.col("text").rlike(r"\b(def|class|import|return|function|select)\b") | (F.regexp_count("text", F.lit(r"[{}()\[\];=<>]")) > 10)
    hold = F.size(F.filter("w", lambda x: x.isin("the", "and", "user", "link", "code")))
    return c.select("conv_id", "turn", "role", code.alias("code"), ((F.size("w") > 0) & (hold >= 0.9 * F.size("w"))).alias("placeholders"))


GRID = """WITH a AS (SELECT list_sort(list(DISTINCT p_type)) AS t, list_sort(list(DISTINCT p_brand)) AS b, list_sort(list(DISTINCT p_size)) AS s FROM part), n AS (SELECT *, len(t) * len(b) * len(s) AS total FROM a)"""


@query(GRID + """, d AS (SELECT min(x) AS stride FROM n, range(1, 100000) r(x) WHERE x >= greatest(1, floor(0.618 * total)) AND gcd(x, total) = 1), i AS (SELECT range AS nth, (5 + range * stride) % total AS i, t, b, s FROM range(24), n, d)
    SELECT nth, t[i % len(t) + 1] AS p_type, b[i // len(t) % len(b) + 1] AS p_brand, s[i // (len(t) * len(b)) % len(s) + 1] AS p_size FROM i""")
def grid_stride_sample(spark, d):
    """24 points of the grid of types, brands and sizes that records have, a stride apart that has no divisor in common with its size."""
    return sampling.grid_points(table(spark, d, "part"), ["p_type", "p_brand", "p_size"], 24, 5)


@query("""SELECT conv_id, turn, so_far FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations) WHERE so_far <= 600""")
def running_size_cut(spark, d):
    """The turns of a conversation while 600 characters hold them."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("so_far")).filter("so_far <= 600")


@query("""SELECT c_custkey, regexp_extract(c_name, '[A-Za-z]+') AS stem, regexp_extract(c_name, '[0-9]+')::BIGINT AS number FROM customer ORDER BY stem DESC, number DESC LIMIT 25""")
def natural_order(spark, d):
    """The last names in order of their letters, then of their digits as a number."""
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "[A-Za-z]+", 0).alias("stem"), F.regexp_extract("c_name", "[0-9]+", 0).cast("long").alias("number")).orderBy(F.desc("stem"), F.desc("number")).limit(25)
