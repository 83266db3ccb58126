"""Queries of the catalogue engine and the same in SQL, by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions import vectors as V
from rankloom.operators import dedupe, evaluation, neighbours, quality, ranking
from rankloom.streaming import events as stream

from . import assessment, assigned, assignments, curation, discovery, intents, languages, measures, phrases, records, retrieval, rules, semantic, shaping, similar, technical  # noqa: F401  (they enter their queries)
from .catalogue import CATALOGUE, CRITERIA, SIGNALS, catalogue, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

# ---- ranking

SCORED = f"""{CATALOGUE}, s AS (SELECT *,
    CASE WHEN task = 'ECONOMY' THEN 3.2e0 WHEN task = 'PROMO' THEN 3.2e0 * 0.85e0 ELSE 0e0 END AS a,
    CASE WHEN list_contains(features, 'small') THEN 1.3e0 WHEN list_contains(features, 'tiny') THEN 1.3e0 * 0.8e0 ELSE 0e0 END AS b,
    CASE WHEN list_contains(features, 'ring') THEN 1.5e0 WHEN list_contains(features, 'widget') THEN 1.5e0 * 0.64e0 ELSE 0e0 END AS c,
    CASE WHEN author = 'Brand#2' THEN 1.0e0 WHEN author = 'Brand#4' THEN 0.9e0 ELSE 0e0 END AS d FROM catalogue),
t AS (SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS n_matched, a + b + c + d AS match_score,
    least(0.5e0 * log10(1 + likes) + 0.25e0 * log10(1 + downloads), 1.5e0) AS signal FROM s)"""


@query(f"""WITH {SCORED} SELECT model_id, n_matched, round(match_score + signal, 5) AS score, round(100 * match_score / 7.0, 4) AS display_score
    FROM t WHERE n_matched >= 2 ORDER BY match_score + signal DESC, model_id LIMIT 20""")
def rank_mcdm_topk(spark, d):
    top = ranking.rank(catalogue(spark, d), CRITERIA, SIGNALS, minimum=2, k=20)
    return top.select("model_id", F.col("n_matched").cast("int").alias("n_matched"), F.round("score", 5).alias("score"), F.round("display_score", 4).alias("display_score"))


@query(f"""WITH {SCORED} SELECT model_id, round(match_score + signal, 5) AS score FROM t
    WHERE n_matched >= 1 AND last_modified <= TIMESTAMP '2000-12-31 23:59:59' AND p_size BETWEEN 5 AND 30 AND NOT list_contains(features, 'red')
    ORDER BY match_score + signal DESC, model_id LIMIT 20""")
def rank_mcdm_filtered(spark, d):
    where = (F.col("last_modified") <= F.lit("2000-12-31 23:59:59").cast("timestamp")) & F.col("p_size").between(5, 30)
    red = ranking.Criterion("red", ("features",), (("red", 1.0),))
    return ranking.rank(catalogue(spark, d), CRITERIA, SIGNALS, where, 1, 20, excluded=[red]).select("model_id", F.round("score", 5).alias("score"))


@query("""WITH m AS (
    SELECT p_partkey AS model_id, v, term, f, w FROM part, (VALUES ('economy','ECONOMY','task',3.2e0),('economy','PROMO','task',3.2e0*0.85e0),('small','small','features',1.3e0),('small','tiny','features',1.3e0*0.8e0),
      ('ring','ring','features',1.5e0),('ring','widget','features',1.5e0*0.64e0),('brand','Brand#2','author',1.0e0),('brand','Brand#4','author',0.9e0),('brand','Brand#2','tags',1.0e0),('brand','Brand#4','tags',0.9e0)) AS c(v, term, f, w)
    WHERE (f = 'task' AND p_type = term) OR (f = 'features' AND list_contains(string_split(p_name, ' '), term)) OR (f = 'author' AND p_brand = term) OR (f = 'tags' AND (p_type = term OR p_brand = term)))
    SELECT model_id, v AS "value", term, f AS field, round(w, 6) AS contribution, row_number() OVER (PARTITION BY model_id, v ORDER BY w DESC, term, f) = 1 AS best FROM m""")
def rank_mcdm_explain(spark, d):
    return ranking.explain(catalogue(spark, d), CRITERIA).withColumn("contribution", F.round("contribution", 6))


@query(f"""WITH {CATALOGUE}, a AS (SELECT model_id, row_number() OVER (ORDER BY likes DESC, model_id) AS r FROM catalogue ORDER BY r LIMIT 300),
    b AS (SELECT model_id, row_number() OVER (ORDER BY p_retailprice DESC, model_id) AS r FROM catalogue ORDER BY r LIMIT 300)
    SELECT model_id, round(sum(w), 8) AS score FROM (SELECT model_id, 1e0 / (60 + r) AS w FROM a UNION ALL SELECT model_id, 1.5e0 / (60 + r) FROM b) GROUP BY model_id""")
def rank_rrf_fusion(spark, d):
    docs = catalogue(spark, d)
    a = ranking.ranked(docs, [F.desc("likes"), F.col("model_id")], 300)
    b = ranking.ranked(docs, [F.desc("p_retailprice"), F.col("model_id")], 300)
    return ranking.fuse([(a, 1.0), (b, 1.5)]).withColumn("score", F.round("score", 8))


BM25 = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: length(w) > 0) AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, {counts} FROM t), g AS (SELECT count(*) AS total, avg(n) AS av, {dfs} FROM c)
    SELECT doc_id, round({score}, 5) AS score FROM c, g WHERE ({any}){extra}"""


def bm25_sql(terms: list[str], no: list[str]) -> str:
    r = range(len(terms))
    counts = ", ".join([*(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms)), *(f"list_contains(w, '{t}') AS x{i}" for i, t in enumerate(no))])
    score = " + ".join(f"ln(1 + (total - d{i} + 0.5e0) / (d{i} + 0.5e0)) * f{i} * 2.2e0 / (f{i} + 1.2e0 * (1 - 0.75e0 + 0.75e0 * n / av))" for i in r)
    return BM25.format(counts=counts, dfs=", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in r), score=score, any=" OR ".join(f"f{i} > 0" for i in r), extra="".join(f" AND NOT x{i}" for i in range(len(no))))


@query(bm25_sql(["then", "thereof", "ander", "there"], []))
def rank_bm25(spark, d):
    return ranking.bm25(table(spark, d, "documents"), ["then", "thereof", "ander", "there"], "doc_id", "text").withColumn("score", F.round("score", 5))


@query(bm25_sql(["and", "with"], ["de", "und"]))
def rank_bm25_must_not(spark, d):
    return ranking.bm25(table(spark, d, "documents"), ["and", "with"], "doc_id", "text", must_not=["de", "und"]).withColumn("score", F.round("score", 5))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 4) AS cosine FROM q, embeddings WHERE vec_id <> query_id)
    SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def rank_knn_cosine(spark, d):
    """Nearest neighbours of a stated query set against all rows."""
    v = table(spark, d, "embeddings")
    return neighbours.nearest_rounded(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, 4).withColumnRenamed("id", "vec_id")


@query(f"""WITH {CATALOGUE}, c AS (SELECT unnest([0, 1, 2, 3]) AS stage, unnest([
      (SELECT count(*) FROM catalogue WHERE task = 'ECONOMY' AND p_size < 3 AND likes > 40 AND list_contains(features, 'red')),
      (SELECT count(*) FROM catalogue WHERE task = 'ECONOMY' AND likes > 40 AND list_contains(features, 'red')),
      (SELECT count(*) FROM catalogue WHERE task = 'ECONOMY' AND list_contains(features, 'red')), (SELECT count(*) FROM catalogue WHERE task = 'ECONOMY')]) AS hits)
    SELECT stage, hits, stage = coalesce((SELECT min(stage) FROM c WHERE hits >= 30), (SELECT arg_max(stage, (hits, -stage)) FROM c)) AS chosen FROM c""")
def rank_relax_staged(spark, d):
    docs = catalogue(spark, d)
    stage, counts = ranking.relax(docs, [("task", F.col("task") == "ECONOMY")], [("size", F.col("p_size") < 3), ("likes", F.col("likes") > 40), ("red", F.array_contains("features", "red"))], 30)
    return spark.createDataFrame([(c["stage"], c["hits"], c["stage"] == stage) for c in counts], "stage int, hits bigint, chosen boolean")


@query(f"""WITH {CATALOGUE} SELECT clause, n FROM (SELECT count(*) FILTER (task = 'ECONOMY') AS task, count(*) FILTER (list_contains(features, 'ring')) AS ring, count(*) FILTER (likes > 1000000) AS likes,
    count(*) FILTER (task = 'ECONOMY' AND list_contains(features, 'ring') AND likes > 1000000) AS "all" FROM catalogue) UNPIVOT (n FOR clause IN (task, ring, likes, "all"))""")
def no_hits_diagnostics(spark, d):
    """Hits of each clause alone and of all: one pass, then long form."""
    c = {"task": F.col("task") == "ECONOMY", "ring": F.array_contains("features", "ring"), "likes": F.col("likes") > 1_000_000}
    c["all"] = c["task"] & c["ring"] & c["likes"]
    return catalogue(spark, d).agg(*(F.count_if(x).alias(k) for k, x in c.items())).unpivot([], list(c), "clause", "n")


@query(f"""WITH {CATALOGUE} SELECT model_id, task, likes FROM catalogue WHERE author LIKE '%#1%' AND task IN ('ECONOMY', 'SMALL') AND last_modified IS NOT NULL AND likes BETWEEN 25 AND 35 ORDER BY likes DESC, downloads DESC, model_id LIMIT 25""")
def filtered_popular(spark, d):
    docs = catalogue(spark, d).filter(F.col("author").contains("#1") & F.col("task").isin("ECONOMY", "SMALL") & F.col("last_modified").isNotNull() & F.col("likes").between(25, 35))
    return docs.orderBy(F.desc("likes"), F.desc("downloads"), "model_id").limit(25).select("model_id", "task", "likes")


@query(f"""WITH {CATALOGUE} SELECT model_id FROM catalogue WHERE (list_contains(features, 'small') OR task = 'small')::INT + (list_contains(features, 'ring') OR task = 'ring')::INT + (list_contains(features, 'ECONOMY') OR task = 'ECONOMY')::INT >= 2""")
def k_of_n_values(spark, d):
    docs = catalogue(spark, d)
    hits = sum((F.array_contains("features", v) | (F.col("task") == v)).cast("int") for v in ("small", "ring", "ECONOMY"))
    return docs.filter(hits >= 2).select("model_id")


# ---- filters and record quality

@query("""SELECT doc_id, short, few_words, low_digits FROM (SELECT doc_id, text IS NULL OR length(trim(text)) < 100 AS short,
    len(list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: length(w) > 0))) < 50 AS few_words,
    length(regexp_replace(text, '[^0-9]', '', 'g')) < 0.05e0 * length(text) AS low_digits FROM documents)""")
def doc_filter_flags(spark, d):
    t = F.col("text")
    few = F.size(F.array_distinct(F.filter(F.split(t, r"[ \t\n\r\x0B\x0C]+"), lambda w: F.length(w) > 0))) < 50
    return table(spark, d, "documents").select("doc_id", (t.isNull() | (F.length(F.trim(t)) < 100)).alias("short"), few.alias("few_words"), (F.length(F.regexp_replace(t, "[^0-9]", "")) < 0.05 * F.length(t)).alias("low_digits"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (length(trim(text)) < 100) AS n_short, count(*) FILTER (quality = 0) AS n_low, count(*) FILTER (length(trim(text)) >= 100 AND coalesce(quality, 1) = 1) AS n_passed
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def doc_filter_counts(spark, d):
    short = F.length(F.trim("text")) < 100
    docs = table(spark, d, "documents").select("doc_id", "lang", short.alias("short")).join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("n_short"), F.count_if(F.col("quality") == 0).alias("n_low"), F.count_if(~F.col("short") & (F.coalesce("quality", F.lit(1)) == 1)).alias("n_passed"))


@query(f"""WITH {CATALOGUE} SELECT model_id, CASE WHEN likes > 30 THEN false WHEN likes < 1 THEN true WHEN last_modified IS NULL THEN true WHEN year(last_modified) > 2000 THEN false ELSE downloads < 500 END AS bad FROM catalogue""")
def low_popularity(spark, d):
    docs = catalogue(spark, d)
    bad = F.when(F.col("likes") > 30, False).otherwise(quality.low_popularity(F.least(F.col("likes"), F.lit(1)), F.col("last_modified"), F.col("downloads") < 500, 2000))
    return docs.select("model_id", bad.alias("bad"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, o_orderdate <= TIMESTAMP '1998-12-31 23:59:59' AS before_1999, o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AS recent FROM orders""")
def recency_flags(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(at).alias("y"), (at <= F.lit("1998-12-31 23:59:59").cast("timestamp")).alias("before_1999"), (at >= F.expr("timestamp '2000-01-01' - interval 365 days")).alias("recent"))


@query("""SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS n_null, count(*) AS n_rows, round(count(*) FILTER (text IS NULL) / count(*), 6) AS null_share FROM (SELECT text, quality FROM documents LEFT JOIN labels USING (doc_id))
    UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(*), round(count(*) FILTER (quality IS NULL) / count(*), 6) FROM (SELECT text, quality FROM documents LEFT JOIN labels USING (doc_id))""")
def null_profile(spark, d):
    return quality.null_profile(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("text", "quality"))


# ---- duplicates, unions, joins

@query("""SELECT doc_id, n_copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n_copies, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_fingerprint_best(spark, d):
    """Aggregation alone: the best row is the minimum of an order, so copies are combined before the shuffle."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("fp"))
    return docs.groupBy("fp").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).drop("fp")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS form FROM documents), k AS (SELECT lower(form) AS key, form, count(*) AS n, (form <> lower(form) AND form <> upper(form))::INT AS mixed FROM w GROUP BY ALL)
    SELECT k.key, arg_min(form, (-mixed, -length(form), form)) AS display, sum(n)::BIGINT AS n_rows, any_value(n_ids) AS n_ids FROM k JOIN (SELECT lower(form) AS key, count(DISTINCT doc_id) AS n_ids FROM w GROUP BY 1) USING (key) GROUP BY k.key""")
def phrase_casefold_merge(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("form"))
    return dedupe.casefold_merged(w, "form", "doc_id")


@query("""SELECT 'c' || c_nationkey AS k, c_custkey AS id, c_acctbal AS acctbal FROM customer UNION ALL SELECT 's' || s_nationkey, s_suppkey, s_acctbal FROM supplier""")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_nationkey").alias("k"))
    return dedupe.union_common(c, s)


@query("""SELECT coalesce(c, s) AS id, CASE WHEN c IS NULL THEN 'right' WHEN s IS NULL THEN 'left' ELSE 'both' END AS place FROM (SELECT DISTINCT o_custkey AS c FROM orders) FULL JOIN (SELECT DISTINCT s_suppkey AS s FROM supplier) ON c = s""")
def set_membership(spark, d):
    return dedupe.membership(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def dict_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return dedupe.merged_right_wins(c, s, "id")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def join_left_totals(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer""")
def join_semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_f", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_f", F.lit(False)))


@query("""SELECT doc_id, coalesce(quality::VARCHAR, 'none') AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def lookup_with_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("verdict"))


@query("""SELECT r_name || '/' || n_name || '/' || s_name AS path, 3 AS depth FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey""")
def taxonomy_paths(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), F.lit(3).alias("depth"))


@query("""WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark), x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents),
    h AS (SELECT doc_id, item_id, count(*) AS hits FROM x JOIN b USING (w) GROUP BY 1, 2)
    SELECT doc_id, item_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, item_id) AS r FROM h) WHERE r <= 5""")
def inverted_index_candidates(spark, d):
    term = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{6,}"), F.lit(0)))).alias("w")
    hits = table(spark, d, "documents").select("doc_id", term("text")).join(table(spark, d, "benchmark").select("item_id", term("text")), "w").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    return dedupe.top_per_group(hits, ["doc_id"], [F.desc("hits"), F.col("item_id")], 5).drop("rank")


# ---- counts, scores, windows

@query("""SELECT CASE WHEN n < 10 THEN 'under 10' WHEN n < 100 THEN '10 to 99' ELSE '100 and more' END AS band, count(*) AS n_words FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w) GROUP BY 1""")
def freq_of_freq_bands(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").count()
    return w.groupBy(F.when(F.col("count") < 10, "under 10").when(F.col("count") < 100, "10 to 99").otherwise("100 and more").alias("band")).agg(F.count(F.lit(1)).alias("n_words"))


@query("""WITH x AS (SELECT w, lang, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY 1, 2)
    SELECT w, sum(n)::BIGINT AS df, arg_min(lang, (-n, lang)) AS top_lang, round(max(n) / sum(n), 6) AS top_share FROM x GROUP BY w HAVING sum(n) BETWEEN 5 AND 400""")
def phrase_document_frequency(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w")).groupBy("w", "lang").agg(F.count(F.lit(1)).alias("n"))
    out = w.groupBy("w").agg(F.sum("n").alias("df"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("top_lang"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))
    return out.filter(F.col("df").between(5, 400))


@query("""WITH x AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY 1, 2),
    y AS (SELECT x.*, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, w) AS r FROM x JOIN documents USING (doc_id))
    SELECT doc_id, w, tf, r AS rank FROM y WHERE r <= greatest(5, least(25, floor(3 * ln(n) - 10)))""")
def phrase_topk_by_length(spark, d):
    docs = table(spark, d, "documents")
    tf = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    return dedupe.top_per_group(tf, ["doc_id"], [F.desc("tf"), F.col("w")], F.greatest(F.lit(5), F.least(F.lit(25), F.floor(3 * F.log("n") - 10)))).drop("n")


def vote():
    return F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)


@query("""SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS n_high, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS n_low, count(*) AS n_all,
    round(CASE WHEN n_high + n_low > 0 THEN n_high / (n_high + n_low) END, 3) AS fuzzy_score, n_high + n_low >= 3 AS eligible FROM lineitem GROUP BY l_partkey""")
def fuzzy_quality_score(spark, d):
    return quality.fuzzy_scores(table(spark, d, "lineitem"), ["l_partkey"], vote())


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, [CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END, (l_quantity % 3)::INT, (l_partkey % 3)::INT] AS v FROM lineitem),
    c AS (SELECT *, list_transform([0, 1, 2], lambda x: len(list_filter(v, lambda y: y = x))) AS n FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN len(list_filter(n, lambda x: x = list_max(n))) > 1 THEN -1 ELSE list_position(n, list_max(n)) - 1 END AS mode FROM c""")
def sentiment_vote(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", quality.row_mode([vote(), (F.col("l_quantity") % 3).cast("int"), (F.col("l_partkey") % 3).cast("int")]).alias("mode"))


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS flag, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, round(avg(l_discount), 6) AS mean_discount, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def quality_feature_stats(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")).select(F.coalesce("l_returnflag", F.lit("TOTAL")).alias("flag"), "n", "n_suppliers", "mean_discount", "least", "most")


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_suppkey""")
def quality_heatmap(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)


@query("""SELECT l_returnflag, l_linestatus, round((sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) - sum(l_quantity)) / nullif(sum(count(*)) OVER (PARTITION BY l_returnflag) - count(*), 0), 6) AS mean_of_others FROM lineitem GROUP BY 1, 2""")
def leave_one_out_mean(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_returnflag")
    n = F.sum("n").over(w) - F.col("n")
    return g.select("l_returnflag", "l_linestatus", F.round((F.sum("s").over(w) - F.col("s")) / F.when(n != 0, n), 6).alias("mean_of_others"))


@query("""SELECT conv_id, turn, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def context_window_snippets(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("after"))


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, '|' ORDER BY turn, role, text) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id""")
def review_tree_flatten(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(rows, lambda x: x["role"]), "|").alias("roles"), F.sum(F.length("text")).alias("n_chars"))


# ---- text

@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', '<CODE>', 'g'), '`[^`]+`', '<CODE>', 'g') AS t FROM documents), u AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'https?://[^ \t\n\r\x0b\x0c]+', '<URL>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]', '<EMAIL>', 'g') AS t FROM c)
    SELECT doc_id, trim(regexp_replace(regexp_replace(t, '(?:[A-Za-z]:\\|~/|\./|/)[A-Za-z0-9_.-]+(?:[/\\][A-Za-z0-9_.-]+)+', '<PATH>', 'g'), '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS text FROM u""")
def text_anonymise(spark, d):
    return table(spark, d, "documents").select("doc_id", X.anonymised(F.col("text")).alias("text"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS text FROM s""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, len(s) AS n_sentences, len(s[1]) AS first_chars FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r\\x0b\\x0c]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents)""")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.length(F.get("s", F.lit(0))).alias("first_chars"))


@query("""SELECT p_partkey, lower(p_name) AS low, upper(replace(p_name, ' ', '-')) AS dashed, replace(p_name, ' ', '') AS compact, array_to_string(regexp_extract_all(lower(p_brand), '[a-z0-9]+'), ' ') AS signature FROM part""")
def alias_variants(spark, d):
    p = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.lower(p).alias("low"), F.upper(F.replace(p, F.lit(" "), F.lit("-"))).alias("dashed"), F.replace(p, F.lit(" "), F.lit("")).alias("compact"), X.token_signature(F.col("p_brand")).alias("signature"))


@query("""SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_fields(spark, d):
    body = F.from_json(X.json_body(F.concat(F.lit("Answer: "), "props")), "k int, missing string")
    return table(spark, d, "events").select("event_id", "event_type", body.alias("b")).select("event_id", "event_type", "b.k", "b.missing")


# ---- vectors and clusters

@query("""WITH p AS (SELECT label AS proto, list(avg ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS avg FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
    s AS (SELECT vec_id, proto, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS cosine FROM embeddings, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, proto) AS k FROM s)
    SELECT vec_id, max(proto) FILTER (k = 1) AS best, round(max(cosine) FILTER (k = 1) - max(cosine) FILTER (k = 2), 6) AS margin FROM r GROUP BY vec_id""")
def domain_assign_margin(spark, d):
    """Nearest class mean and its lead. The means are a small, stated set: one row that every vector meets; top two by array, not by window."""
    v = table(spark, d, "embeddings")
    means = v.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    all_means = means.agg(F.collect_list(F.struct("label", "c")).alias("means"))
    scored = v.crossJoin(F.broadcast(all_means)).select("vec_id", F.array_sort(F.transform("means", lambda p: F.struct((-F.round(V.cosine(F.col("embedding"), p["c"]), 6)).alias("s"), p["label"].alias("label")))).alias("x"))
    return scored.select("vec_id", F.get("x", F.lit(0))["label"].alias("best"), F.round(F.get("x", F.lit(1))["s"] - F.get("x", F.lit(0))["s"], 6).alias("margin"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 'ring' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'house' ELSE 'other' END AS family,
    CASE WHEN p_type = 'ECONOMY' THEN 0.93 WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 0.97 WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 0.88 ELSE 0.0 END::DOUBLE AS confidence FROM part""")
def family_cascade(spark, d):
    """The first rule of a cascade that holds gives family and confidence."""
    rules = [(F.col("p_type") == "ECONOMY", "economy", 0.93), (F.array_contains(F.split("p_name", " "), "ring"), "ring", 0.97), (F.col("p_brand").isin("Brand#1", "Brand#2"), "house", 0.88)]
    family, confidence = F.lit("other"), F.lit(0.0)
    for test, name, sure in reversed(rules):
        family, confidence = F.when(test, name).otherwise(family), F.when(test, sure).otherwise(confidence)
    return table(spark, d, "part").select("p_partkey", family.alias("family"), confidence.alias("confidence"))


@query("""SELECT p_type AS parent, p_brand AS child, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_type), 6) AS share FROM part GROUP BY 1, 2""")
def family_relations(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("parent"), F.col("p_brand").alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("parent")), 6))


@query("""SELECT p_partkey AS src, 'feature:' || unnest(string_split(p_name, ' ')) AS dst, 'has_feature' AS kind FROM part UNION ALL SELECT p_partkey, 'task:' || p_type, 'has_task' FROM part UNION ALL SELECT p_partkey, 'author:' || p_brand, 'has_author' FROM part""")
def kg_edges(spark, d):
    edge = lambda kind, name: F.struct(F.concat(F.lit(kind + ":"), name).alias("dst"), F.lit("has_" + kind).alias("kind"))
    parts = F.concat(F.transform(F.split("p_name", " "), lambda x: edge("feature", x)), F.array(edge("task", F.col("p_type")), edge("author", F.col("p_brand"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(parts).alias("e")).select("src", "e.*")


# ---- evaluation

@query("""SELECT p_type, count(*) AS n, round(avg(coalesce((r = 1)::INT, 0)), 6) AS hit_1, round(avg((coalesce(r, 99) <= 10)::INT), 6) AS hit_k, round(avg(CASE WHEN r <= 10 THEN 1e0 / r ELSE 0 END), 6) AS mrr,
    round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN r <= 10 THEN 0.1e0 ELSE 0e0 END), 6) AS p_k, round(avg(r), 6) AS mean_rank
    FROM (SELECT p_type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 15 + 1 END AS r FROM part) GROUP BY p_type""")
def eval_rank_metrics(spark, d):
    rank = F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size") % 15 + 1)
    return evaluation.rank_metrics(table(spark, d, "part").withColumn("r", rank), ["p_type"], F.col("r"))


@query("""WITH s AS (SELECT list_distinct(string_split(p_name, ' ')) AS p, list_distinct(string_split(p_name, ' ')[1:1] || ['ring']) AS t FROM part),
    c AS (SELECT sum(len(list_intersect(p, t)))::BIGINT AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(t, x))))::BIGINT AS fp, sum(len(list_filter(t, lambda x: NOT list_contains(p, x))))::BIGINT AS fn FROM s)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM c""")
def eval_set_overlap(spark, d):
    w = F.split("p_name", " ")
    sets = table(spark, d, "part").select(w.alias("p"), F.array(F.get(w, F.lit(0)), F.lit("ring")).alias("t"))
    return evaluation.set_overlap(sets, "p", "t")


PREDICTED = "CASE WHEN length(regexp_replace(text, '[^!#*$%&]', '', 'g')) > 0.02e0 * length(text) OR length(text) < 200 THEN 0 ELSE 1 END"


def judged(spark, d):
    odd = (F.length(F.regexp_replace("text", "[^!#*$%&]", "")) > 0.02 * F.length("text")) | (F.length("text") < 200)
    docs = table(spark, d, "documents").select("doc_id", F.when(odd, 0).otherwise(1).alias("predicted"), (F.length("text") >= 500).alias("long"), "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id")


@query(f"""WITH j AS (SELECT quality AS t, {PREDICTED} AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM j, (VALUES (0), (1)) v(label) GROUP BY label)
    SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou FROM c""")
def eval_classification_report(spark, d):
    return evaluation.label_report(judged(spark, d), "quality", "predicted")


@query(f"""SELECT quality AS truth, {PREDICTED} AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def eval_confusion(spark, d):
    return evaluation.confusion(judged(spark, d), "quality", "predicted")


@query(f"""WITH j AS (SELECT quality, n_chars, {PREDICTED} AS predicted, (length(text) >= 500)::INT AS long FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (predicted = quality AND long <> quality) AS n10, count(*) FILTER (predicted <> quality AND long = quality) AS n01 FROM j),
    k AS (SELECT *, n10 + n01 AS n, least(n10, n01) AS k FROM c) SELECT n10, n01, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(k + 1) t(i))), 9) AS p_value FROM k""")
def eval_mcnemar(spark, d):
    j = judged(spark, d)
    return evaluation.mcnemar(j, F.col("predicted") == F.col("quality"), F.col("long").cast("int") == F.col("quality"))


@query("""SELECT 'n_chars' AS a, 'quality' AS b, round(corr(n_chars, quality), 6) AS pearson FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'quality', 'toxic', round(corr(quality, toxic), 6) FROM documents JOIN labels USING (doc_id)""")
def eval_correlations(spark, d):
    return evaluation.correlations(judged(spark, d), [("n_chars", "quality"), ("quality", "toxic")])


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT doc_id, lang FROM documents JOIN n USING (lang) WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 < 100000000 / n""")
def sample_stratified(spark, d):
    """About 100 documents of each language: shares from counts, rows by the hash of their id, alike in every run."""
    docs = table(spark, d, "documents")
    n = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000
    return docs.select("doc_id", "lang").join(n, "lang").filter(place < 100_000_000 / F.col("n")).select("doc_id", "lang")


# ---- events

@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, d):
    return stream.tumbling(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))
