"""Further evaluation, sampling and quality queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import dedupe, evaluation

from .catalogue import table
from .registry import query

#: A stand-in for experiment runs: one row a line item, the rank of the right answer (null: not found) by configuration.
RUNS = "runs AS (SELECT l_orderkey AS sample, (l_suppkey % 5)::INT AS config, l_returnflag AS param, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE (l_partkey % 17 + 1)::INT END AS r FROM lineitem)"


def runs(spark, d):
    rank = F.when(F.col("l_linenumber") % 4 == 0, None).otherwise((F.col("l_partkey") % 17 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 5).cast("int").alias("config"), F.col("l_returnflag").alias("param"), rank.alias("r"))


@query(f"""WITH {RUNS} SELECT config, count(*) AS n, round(avg((coalesce(r, 99) = 1)::INT), 6) AS hit_1, round(avg((coalesce(r, 99) <= 10)::INT), 6) AS hit_10, round(avg(CASE WHEN r <= 10 THEN 1e0 / r ELSE 0 END), 6) AS mrr, count(*) FILTER (r IS NULL) AS n_missed,
    round(avg(r), 4) AS mean_rank FROM runs GROUP BY config""")
def eval_experiment_ranking(spark, d):
    r = F.col("r")
    return runs(spark, d).groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce(r, F.lit(99)) == 1).cast("int")), 6).alias("hit_1"), F.round(F.avg((F.coalesce(r, F.lit(99)) <= 10).cast("int")), 6).alias("hit_10"),
        F.round(F.avg(F.when(r <= 10, 1.0 / r).otherwise(0.0)), 6).alias("mrr"), F.count_if(r.isNull()).alias("n_missed"), F.round(F.avg(r), 4).alias("mean_rank"))


@query(f"""WITH {RUNS}, g AS (SELECT sample, config, min(r) AS best FROM runs GROUP BY 1, 2)
    SELECT sample, config, coalesce(best, 0) AS best FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY coalesce(best, 999), config) AS k FROM g) WHERE k = 1""")
def eval_best_experiment(spark, d):
    """The best configuration of each sample, as the minimum of an order: no window, combined before the shuffle."""
    best = F.min_by(F.struct("config", "r"), F.struct(F.coalesce("r", F.lit(999)), F.col("config"))).alias("x")
    return runs(spark, d).groupBy("sample").agg(best).select("sample", "x.config", F.coalesce("x.r", F.lit(0)).alias("best"))


@query(f"""WITH {RUNS}, s AS (SELECT param, avg((coalesce(r, 99) <= 10)::INT) AS m, count(*) AS n, sum((coalesce(r, 99) <= 10)::INT) AS k FROM runs GROUP BY param), t AS (SELECT sum(n) AS n_all, sum(k) AS k_all FROM s)
    SELECT param, n, round(m, 6) AS mean, round((k_all - k) / nullif(n_all - n, 0), 6) AS mean_of_others, round(m - (k_all - k) / nullif(n_all - n, 0), 6) AS effect FROM s, t""")
def eval_parameter_effects(spark, d):
    """Mean of each parameter value, against the mean of all others."""
    hit = (F.coalesce("r", F.lit(99)) <= 10).cast("int")
    s = runs(spark, d).groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("k"))
    n_all, k_all = (s.agg(F.sum(c)).scalar() for c in ("n", "k"))
    others = (k_all - F.col("k")) / F.when(n_all - F.col("n") != 0, n_all - F.col("n"))
    mean = F.col("k") / F.col("n")
    return s.select("param", "n", F.round(mean, 6).alias("mean"), F.round(others, 6).alias("mean_of_others"), F.round(mean - others, 6).alias("effect"))


@query(f"""WITH {RUNS}, s AS (SELECT config, avg((coalesce(r, 99) <= 10)::INT) AS m, count(*) AS w FROM runs GROUP BY config)
    SELECT round(sum(w * m) / sum(w), 6) AS mean, round(sqrt(greatest(sum(w * m * m) / sum(w) - pow(sum(w * m) / sum(w), 2), 0)), 6) AS weighted_std FROM s""")
def eval_weighted_spread(spark, d):
    """Weighted standard deviation of group means."""
    s = runs(spark, d).groupBy("config").agg(F.avg((F.coalesce("r", F.lit(99)) <= 10).cast("int")).alias("m"), F.count(F.lit(1)).alias("w"))
    mean = F.sum(F.col("w") * F.col("m")) / F.sum("w")
    square = F.sum(F.col("w") * F.col("m") * F.col("m")) / F.sum("w")
    return s.agg(F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 6).alias("weighted_std"))


@query("""WITH t AS (SELECT l_orderkey AS q, l_linenumber AS pos, (l_returnflag = 'A')::INT AS rel FROM lineitem), g AS (SELECT q, count(*) FILTER (rel = 1 AND pos <= 5) AS hits, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS dcg, sum(rel) AS total FROM t GROUP BY q)
    SELECT q, hits / 5e0 AS p_5, round(CASE WHEN total > 0 THEN hits / total ELSE 0 END, 6) AS recall_5, round(CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(total, 5)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_5 FROM g""")
def eval_family_ndcg(spark, d):
    """Precision, recall and nDCG at 5 with several relevant items a query."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "A").cast("int").alias("rel"))
    g = t.groupBy("q").agg(F.sum(F.when(F.col("pos") <= 5, F.col("rel")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("pos") <= 5, F.col("rel") / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"), F.sum("rel").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("total"), F.lit(5))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.col("total") > 0
    return g.select("q", (F.col("hits") / 5.0).alias("p_5"), F.round(F.when(some, F.col("hits") / F.col("total")).otherwise(0.0), 6).alias("recall_5"), F.round(F.when(some, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg_5"))


@query("""WITH s AS (SELECT list_distinct(string_split(p_name, ' ')) AS p, list_distinct([string_split(p_name, ' ')[1], 'ring']) AS t FROM part)
    SELECT round(avg((len(list_filter(p, lambda x: NOT list_contains(t, x))) = 0)::INT), 6) AS subset_accuracy, round(avg(len(list_intersect(p, t)) / (len(p) + len(t) - len(list_intersect(p, t)))), 6) AS mean_jaccard FROM s""")
def eval_subset_jaccard(spark, d):
    w = F.split("p_name", " ")
    s = table(spark, d, "part").select(w.alias("p"), F.array(F.get(w, F.lit(0)), F.lit("ring")).alias("t"))
    return s.agg(F.round(F.avg((F.size(F.array_except("p", "t")) == 0).cast("int")), 6).alias("subset_accuracy"), F.round(F.avg(X.jaccard(F.col("p"), F.col("t"))), 6).alias("mean_jaccard"))


@query("""SELECT cell, count(*) AS n FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'TP' WHEN quality = 1 THEN 'FN' WHEN toxic = 0 THEN 'FP' ELSE 'TN' END AS cell FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) GROUP BY cell""")
def eval_cells(spark, d):
    """Rows by the cell that two verdicts put them in; incomplete rows out."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    cell = F.when(good & clean, "TP").when(good, "FN").when(clean, "FP").otherwise("TN")
    return table(spark, d, "labels").dropna().groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN a ELSE 1 END AS agreed, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS majority FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS a, (l_quantity % 3)::INT AS b, (l_partkey % 3)::INT AS c FROM lineitem)""")
def agreement_labels(spark, d):
    """Two annotators' agreement, else neutral; the majority of three, else the first."""
    a = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), (F.col("l_quantity") % 3).cast("int").alias("b"), (F.col("l_partkey") % 3).cast("int").alias("c"))
    a, b, c = (F.col(x) for x in "abc")
    return v.select("l_orderkey", "l_linenumber", F.when(a == b, a).otherwise(1).alias("agreed"), F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a).alias("majority"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, arg_min(lang, (-n, lang)) AS mode, max(n) AS n_mode, sum(n)::BIGINT AS n FROM g GROUP BY source""")
def group_mode(spark, d):
    """The most frequent value of each group, first in order on a tie, from counts."""
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("mode"), F.max("n").alias("n_mode"), F.sum("n").alias("n"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, avg(x) AS mean, stddev_pop(x) AS sd FROM s GROUP BY 1)
    SELECT l_suppkey, l_partkey, round((x - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM s JOIN m USING (l_suppkey)""")
def zscore_in_group(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_extendedprice").alias("x"))
    m = s.groupBy("l_suppkey").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return s.join(m, "l_suppkey").select("l_suppkey", "l_partkey", F.round((F.col("x") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 4).alias("z"))


@query("""SELECT source, sentiment, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT coalesce(source, '') AS source, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'none' END AS sentiment, doc_id FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((), (source), (sentiment))""")
def review_statistics(spark, d):
    """Totals, by source and by verdict, in one pass: grouping sets."""
    s = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = s.withColumn("sentiment", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("none"))
    return s.groupingSets([[], ["source"], ["sentiment"]], "source", "sentiment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("""WITH g AS (SELECT l_partkey, l_shipmode, h, l FROM (SELECT l_partkey, l_linestatus AS l_shipmode, count(*) FILTER (l_returnflag = 'A') AS h, count(*) FILTER (l_returnflag = 'R') AS l FROM lineitem GROUP BY 1, 2)), t AS (SELECT l_partkey FROM g WHERE h + l >= 3 GROUP BY l_partkey ORDER BY sum(h + l) DESC, l_partkey LIMIT 20)
    SELECT l_partkey, round(max(CASE WHEN l_shipmode = 'F' THEN h / (h + l) END), 3) AS F, round(max(CASE WHEN l_shipmode = 'O' THEN h / (h + l) END), 3) AS O FROM g JOIN t USING (l_partkey) WHERE h + l >= 3 GROUP BY l_partkey""")
def quality_heatmap_top(spark, d):
    """Eligible scores of the 20 records with most votes, an attribute a column."""
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.count_if(F.col("l_returnflag") == "A").alias("h"), F.count_if(F.col("l_returnflag") == "R").alias("l")).filter("h + l >= 3")
    top = g.groupBy("l_partkey").agg(F.sum(F.col("h") + F.col("l")).alias("votes")).orderBy(F.desc("votes"), "l_partkey").limit(20)
    return g.join(top, "l_partkey").groupBy("l_partkey").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.max(F.col("h") / (F.col("h") + F.col("l"))), 3))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_retailprice, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS quarter, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), 6) AS share FROM part) SELECT p_partkey, quarter, share FROM s""")
def price_quartiles(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"))


@query("""SELECT doc_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS a, list_distinct(regexp_extract_all(lower(source || ' then thereof there with from'), '[a-z]{4,}')) AS b FROM documents WHERE source IS NOT NULL)""")
def overlap_coefficient(spark, d):
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", tokens(F.col("text")).alias("a"), tokens(F.concat("source", F.lit(" then thereof there with from"))).alias("b"))
    return docs.select("doc_id", F.round(X.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""WITH d AS (SELECT doc_id, n_chars > (SELECT median(n_chars) FROM documents) AS long, md5(doc_id::VARCHAR) AS h FROM documents) SELECT doc_id, long FROM (SELECT *, row_number() OVER (PARTITION BY long ORDER BY h, doc_id) AS n FROM d) WHERE n <= 250 AND long IS NOT NULL""")
def sample_balanced(spark, d):
    """250 documents each of the longer and the shorter half, chosen by the hash of their id: the size is the feature."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    half = docs.agg(F.percentile("n_chars", 0.5)).scalar()  # counts of lengths, of which there are few
    marked = docs.withColumn("long", F.col("n_chars") > half).withColumn("h", F.md5(F.col("doc_id").cast("string")))
    part = lambda long: marked.filter(F.col("long") == long).orderBy("h", "doc_id").limit(250)
    return part(True).unionByName(part(False)).select("doc_id", "long")


@query("""SELECT doc_id, acronym, n FROM (SELECT doc_id, acronym, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Z0-9]{1,7}')) AS acronym FROM documents) GROUP BY 1, 2)""")
def acronym_counts(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Z0-9]{1,7}"), F.lit(0))).alias("acronym"))
    return a.groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT o_custkey, n, round(total, 2) AS total FROM c ORDER BY n, o_custkey LIMIT 15 OFFSET 10""")
def bottom_with_offset(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.orderBy("n", "o_custkey").offset(10).limit(15)


@query("""SELECT truth AS label, round(recall, 6) AS recall FROM (SELECT quality AS truth, avg((toxic = 1 - quality)::INT) AS recall FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality)""")
def eval_recall_by_label(spark, d):
    return evaluation.confusion(table(spark, d, "labels").dropna().withColumn("p", 1 - F.col("toxic")), "quality", "p").groupBy(F.col("truth").alias("label")).agg(F.round(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recall"))


@query("""SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text) AS r FROM conversations) WHERE r <= 2""")
def longest_turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return dedupe.top_per_group(c, ["conv_id"], [F.desc(F.length("text")), F.col("turn"), F.col("text")], 2).drop("rank")
