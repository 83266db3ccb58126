"""Queries that filter, join, merge and summarise records."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import phrases
from rankloom.operators import records

from .catalogue import CATALOGUE, catalogue, table
from .registry import query


@query(r"""WITH t AS (SELECT doc_id, text, length(trim(coalesce(text, ''))) AS n, len(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS k, (length(text) - length(replace(text, 'en', ''))) / 2 AS hits, regexp_matches(coalesce(text, ''), '(?i)lorem ipsum|todo|coming soon|more information needed') AS holds FROM documents)
    SELECT doc_id, text IS NULL OR n < 100 OR (k < 50 AND holds) AS bad, text IS NULL OR n < 100 OR (k < 30 AND hits > 5) OR k < 20 OR holds AS bad_strict, regexp_matches(coalesce(text, ''), '^[\x{0000}-\x{024F}\s]*$') AS latin FROM t""")
def description_problems(spark, d):
    """Too short, or few distinct words and a placeholder; the strict form; nothing but Latin characters."""
    return table(spark, d, "documents").select("doc_id", *records.description_problems(F.col("text"), "en"))


@query(f"""WITH {CATALOGUE}, l AS (SELECT model_id FROM catalogue WHERE downloads < 500 AND p_size < 20)
    SELECT model_id, CASE WHEN likes > 30 THEN 'keep' WHEN likes BETWEEN 1 AND 30 THEN CASE WHEN last_modified IS NULL THEN 'bad' WHEN year(last_modified) > 2000 THEN 'keep' WHEN l.model_id IS NOT NULL THEN 'bad' ELSE 'keep' END ELSE 'bad' END AS popularity, len(features) <= 1 AS few_files, likes < 20 AND task IS NULL AS no_tag FROM catalogue LEFT JOIN l USING (model_id)""")
def popularity_rules(spark, d):
    """The popularity rule with its three branches; the low-download set fails both of its limits."""
    c = catalogue(spark, d)
    low = c.filter((F.col("downloads") < 500) & (F.col("p_size") < 20)).select("model_id", F.lit(True).alias("low"))
    return c.join(low, "model_id", "left").select("model_id", records.popularity("likes", "last_modified", "low", 30, 2000).alias("popularity"), (F.size("features") <= 1).alias("few_files"), ((F.col("likes") < 20) & F.col("task").isNull()).alias("no_tag"))


@query("""SELECT p_partkey, p_retailprice / 2000 > 0.6 AS good, p_retailprice BETWEEN 1000 - 100 AND 1000 + 100 AS about_1000, p_brand IN ('Brand#1', 'Brand#2') OR coalesce(TRY_CAST(replace(p_brand, 'Brand#', '') AS INT), 0) >= 20 AS venue,
    regexp_full_match(replace(p_name, ' ', '/'), '[a-z]{3,}/[a-z]{3,}') AS plausible, NOT regexp_matches(p_name, '^(small|tiny|red)') AS no_prefix, regexp_matches(p_type, '^(ECONOMY|PROMO)') AND NOT regexp_matches(p_name, 'gizmo') AS allowed, p_retailprice / 2000 >= (4 - 1) / 4.0 AS rated_4 FROM part""")
def value_predicates(spark, d):
    """Threshold, about (a tenth or 1e-3), ranks or numbers, plausible ids, prefixes, allow and deny lists, ratings as thresholds."""
    price, name = F.col("p_retailprice"), F.col("p_name")
    number = F.expr("try_cast(replace(p_brand, 'Brand#', '') AS INT)")
    return table(spark, d, "part").select("p_partkey", (price / 2000 > 0.6).alias("good"), records.about(price, 1000.0).alias("about_1000"), (F.col("p_brand").isin("Brand#1", "Brand#2") | (F.coalesce(number, F.lit(0)) >= 20)).alias("venue"), F.replace(name, F.lit(" "), F.lit("/")).rlike("^[a-z]{3,}/[a-z]{3,}$").alias("plausible"), (~name.rlike("^(small|tiny|red)")).alias("no_prefix"), (F.col("p_type").rlike("^(ECONOMY|PROMO)") & ~name.rlike("gizmo")).alias("allowed"), (price / 2000 >= records.rating_threshold(4)).alias("rated_4"))


@query(r"""WITH p AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS p FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split_regex(text, '\s+') AS w FROM benchmark)))
    SELECT p AS phrase, CASE WHEN NOT regexp_matches(p, '[A-Za-z]') THEN 'symbols' WHEN regexp_matches(lower(p), '^(the|a|an|this|that) ') THEN 'determiner' WHEN lower(p) IN ('of and', 'in the') THEN 'stop' WHEN regexp_matches(p, '[0-9]') THEN 'digits' WHEN starts_with(lower(p), 'thing') THEN 'prefix' ELSE 'valid' END AS verdict FROM p""")
def phrase_validity(spark, d):
    """Pairs of words that make no phrase, and the first reason why."""
    w = F.split("text", r"\s+")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    p = table(spark, d, "benchmark").filter(F.size(w) > 1).select(F.explode(pairs).alias("phrase")).distinct()
    return p.select("phrase", records.phrase_verdict(F.col("phrase"), ("of and", "in the"), ("thing",)).alias("verdict"))


@query("""WITH m AS (SELECT p_name AS name, p_partkey AS id FROM part), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT min(p_name) FROM part) ELSE 'no such model' END AS topic FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, coalesce(id::VARCHAR, topic) AS model FROM t LEFT JOIN m ON name = topic""")
def name_fanout(spark, d):
    """A name meets all ids that bear it; a name that none bears stands for itself."""
    m = table(spark, d, "part").select(F.col("p_name").alias("topic"), F.col("p_partkey").cast("string").alias("id"))
    first = m.agg(F.min("topic").alias("t"))
    t = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, first.scalar()).otherwise("no such model").alias("topic"))
    return records.fanned(t, m, "topic", "id").select("o_orderkey", F.coalesce("id", "topic").alias("model"))


@query("""WITH a AS (SELECT item_id, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 3), ' ') AS alias FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS t FROM documents)
    SELECT doc_id, item_id FROM t JOIN a ON contains(t, ' ' || alias || ' ') AND alias <> ''""")
def alias_in_text(spark, d):
    """Texts that hold an alias, word by word. The alias's longest word is the join key, so no text meets an alias that it can't hold."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    alias = table(spark, d, "benchmark").select("item_id", F.slice(words("text"), 1, 3).alias("w"))
    return records.phrase_hits(table(spark, d, "documents").select("doc_id", words("text").alias("w")), alias, "doc_id", "item_id")


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), o AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 3 = 1 THEN 'Supplier#' || lpad((c_custkey % 20)::VARCHAR, 9, '0') END AS url FROM customer)
    SELECT c_custkey, coalesce(a.s_name, b.s_name, c.s_name) AS found FROM o LEFT JOIN s a ON a.s_suppkey = id LEFT JOIN s b ON b.s_name = url LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM s GROUP BY 1) c ON c.s_nationkey = c_nationkey""")
def fallback_lookup(spark, d):
    """By id, else by address, else by title: the first that is found."""
    s = table(spark, d, "supplier")
    o = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 20).cast("string"), 9, "0"))).alias("url"), F.col("c_nationkey").alias("title"))
    return records.first_found(o, [(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("v")), "id"), (s.select(F.col("s_name").alias("url"), F.col("s_name").alias("v")), "url"), (s.groupBy(F.col("s_nationkey").alias("title")).agg(F.min("s_name").alias("v")), "title")], "v", "found").select("c_custkey", "found")


@query("""WITH e AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM e GROUP BY 1)
    SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)), 6) AS cosine FROM e a JOIN e b ON a.i = b.i AND a.label < b.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2 HAVING sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)) >= 0.05""")
def similar_centroids(spark, d):
    """Pairs of class centres at a cosine of 0.05 or more. Classes are few; their places in the vector are the join key."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return records.similar_pairs(e, "label", 0.05).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events), v AS (SELECT event_id, path, json_extract_string(props, path) AS v FROM k)
    SELECT path, count(DISTINCT event_id) AS assigned, count(DISTINCT v) AS n_unique, array_to_string(list_slice(list_sort(list_distinct(list(v))), 1, 3), ',') AS samples FROM v GROUP BY path""")
def path_profile(spark, d):
    """For each path of a record: documents that have it, distinct values and the three smallest."""
    v = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "v"))
    return records.path_profile(v, "event_id")


@query("""WITH r AS (SELECT p_type AS feature, l_shipmode AS s, 1 AS x FROM part, (SELECT 1 AS l_shipmode) LIMIT 0), e AS (SELECT p_type AS feature, l_returnflag AS s, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), w AS (SELECT arg_max(s, (m, s)) AS s FROM (SELECT s, avg(rate) AS m FROM e GROUP BY s))
    SELECT feature, round(avg(rate) + 0.5 * stddev_pop(rate) + 0.25 * max(CASE WHEN s = (SELECT s FROM w) THEN rate END), 6) AS score FROM e GROUP BY feature""".replace("WITH r AS (SELECT p_type AS feature, l_shipmode AS s, 1 AS x FROM part, (SELECT 1 AS l_shipmode) LIMIT 0), e AS", "WITH e AS"))
def balanced_errors(spark, d):
    """Mean error over sets, its spread and the rate in the weakest set, weighted."""
    rate = F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)).alias("rate")
    e = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("feature"), F.col("l_returnflag").alias("set")).agg(rate)
    return records.balanced_error(e, 0.5, 0.25).withColumn("score", F.round("score", 6))


@query("""SELECT event_type AS method, count(*) AS n, count(DISTINCT user_id) AS n_items, count(c_custkey) AS n_known, count(DISTINCT c_custkey) AS known_items, round(avg(c_acctbal), 4) AS mean_popularity, round(median(c_acctbal), 4) AS median_popularity, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(user_id) FILTER (c_custkey IS NULL))), 1, 3), ','), '') AS missing
    FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY event_type""")
def method_coverage(spark, d):
    """What each method recommends, how much of it is known, how popular that is, and the first ids that are not."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("k"))  # once a method and item
    j = e.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    known = F.when(F.col("c_custkey").isNotNull(), F.col("k")).otherwise(0)
    missing = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("c_custkey").isNull(), F.col("user_id")))), 1, 3), ",")
    return j.groupBy(F.col("event_type").alias("method")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_items"), F.sum(known).alias("n_known"), F.count("c_custkey").alias("known_items"), F.round(F.sum(F.col("c_acctbal") * F.col("k")) / F.sum(known), 4).alias("mean_popularity"), F.round(F.percentile("c_acctbal", 0.5, F.col("k")), 4).alias("median_popularity"), missing.alias("missing"))


@query("""WITH p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN n_chars > 600 THEN 'good' ELSE 'bad' END AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT unnest(['good', 'bad']) AS c), m AS (SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (p = c) AS pp, count(*) FILTER (t = c) AS tt FROM p, c GROUP BY c),
    f AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS re FROM m), g AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM f)
    SELECT round(sum(tp) / sum(tt), 6) AS accuracy, round(avg(pr), 6) AS macro_p, round(avg(re), 6) AS macro_r, round(avg(f1), 6) AS macro_f1, round(sum(pr * tt) / sum(tt), 6) AS weighted_p, round(sum(re * tt) / sum(tt), 6) AS weighted_r, round(sum(f1 * tt) / sum(tt), 6) AS weighted_f1 FROM g""")
def macro_weighted_report(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").filter("quality IS NOT NULL")
    return records.averaged_report(p.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n_chars") > 600, "good").otherwise("bad").alias("predicted")))


@query("""WITH k AS (SELECT l_partkey, l_shipmode AS m, 0 AS n FROM (SELECT 1 AS l_partkey, 'x' AS l_shipmode) WHERE false), c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_partkey, round(avg(l_discount), 6) AS discount, sum(l_linenumber)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS statuses, any_value(m) AS mode FROM lineitem JOIN (SELECT l_partkey, arg_max(l_returnflag, (n, -ascii(l_returnflag))) AS m FROM c GROUP BY 1) USING (l_partkey) GROUP BY l_partkey""".replace("WITH k AS (SELECT l_partkey, l_shipmode AS m, 0 AS n FROM (SELECT 1 AS l_partkey, 'x' AS l_shipmode) WHERE false), c AS", "WITH c AS"))
def merge_by_key(spark, d):
    """Numbers averaged or summed, lists united, categories by their mode (first on a tie), in one pass."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.sum(F.col("l_linenumber").cast("long")).alias("n"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"), F.mode("l_returnflag", deterministic=True).alias("mode"))


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), x AS (SELECT b.k, b.v, a.k IS NOT NULL AND a.v <> b.v AS clash FROM b LEFT JOIN a USING (k)), m AS (SELECT greatest((SELECT max(k) FROM a), (SELECT max(k) FROM b)) AS m)
    SELECT k, v FROM a UNION SELECT CASE WHEN clash THEN m + row_number() OVER (PARTITION BY clash ORDER BY k) ELSE k END AS k, v FROM x, m""")
def dict_merge_rekeyed(spark, d):
    """Two dictionaries in one; an entry whose key is taken by another value gets a new key after the largest."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return records.merged_rekeyed(a, b, "k", "v")


@query("""WITH w AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) AS key, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END AS term, p_retailprice AS weight FROM part)
    SELECT trim(key) AS key, arg_min(term, (-weight, length(term), term)) AS term, max(weight) AS weight FROM w GROUP BY trim(key)""")
def dedupe_by_normal_key(spark, d):
    """One term for each normal form: the best weight, then the shorter."""
    term = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" "))
    w = table(spark, d, "part").select(term.alias("term"), F.col("p_retailprice").alias("weight")).withColumn("key", F.trim(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", " ")))
    return w.groupBy("key").agg(F.min_by("term", F.struct(-F.col("weight"), F.length("term"), F.col("term"))).alias("term"), F.max("weight").alias("weight"))


@query("""WITH t AS (SELECT conv_id, turn % 3 AS voter, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) AS w FROM conversations), v AS (SELECT conv_id, w, count(DISTINCT voter) AS n FROM t GROUP BY 1, 2)
    SELECT conv_id, coalesce(array_to_string(list_sort(list(w) FILTER (n >= 2)), ' '), '') AS agreed, count(*) FILTER (n = 1) AS alone FROM v GROUP BY conv_id""")
def two_of_three(spark, d):
    """Words that two of three voters list, and how many only one does."""
    t = table(spark, d, "conversations").select("conv_id", (F.col("turn") % 3).alias("voter"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    v = t.groupBy("conv_id", "w").agg(F.count_distinct("voter").alias("n"))
    return v.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.col("w")))), " ").alias("agreed"), F.count_if(F.col("n") == 1).alias("alone"))


@query("""WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents), f AS (SELECT w, count(*) AS df FROM w GROUP BY w)
    SELECT w AS phrase, round(0.5 * regexp_matches(w, 'tion$|ment$')::INT + 0.2 * (length(w) BETWEEN 4 AND 8)::INT + 1.0 / df, 6) AS score FROM f ORDER BY score DESC, phrase LIMIT 50""")
def feature_scores(spark, d):
    """Half a point for a capability, 0.2 for a fair length, and what is rare first: the top 50 are the feature."""
    f = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    score = 0.5 * F.col("phrase").rlike("tion$|ment$").cast("int") + 0.2 * F.length("phrase").between(4, 8).cast("int") + 1 / F.col("df")
    return f.select("phrase", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "phrase").limit(50)


@query("""SELECT l_partkey, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1 ORDER BY n, l_partkey LIMIT 20""")
def least_repeated(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("n", "l_partkey").limit(20)


@query("""WITH h AS (SELECT user_id AS experiment, value > 5 AS hit1, value > 3 AS hit10, value FROM events WHERE value IS NOT NULL), e AS (SELECT experiment, avg(hit1::INT) AS h1, avg(hit10::INT) AS h10, avg(value) AS r, sum(value) AS s, count(*) AS n FROM h GROUP BY 1) SELECT experiment, round(h1, 6) AS h1, round(h10, 6) AS h10, n FROM e ORDER BY e.h1 DESC, e.h10 DESC, r, s DESC, experiment LIMIT 1""")
def best_experiment_five(spark, d):
    """The best of all experiments in an order of five keys."""
    e = table(spark, d, "events").filter("value IS NOT NULL").groupBy(F.col("user_id").alias("experiment")).agg(F.avg((F.col("value") > 5).cast("int")).alias("x1"), F.avg((F.col("value") > 3).cast("int")).alias("x10"), F.avg("value").alias("r"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("x1"), F.desc("x10"), "r", F.desc("s"), "experiment").limit(1).select("experiment", F.round("x1", 6).alias("h1"), F.round("x10", 6).alias("h10"), "n")


@query("""WITH r AS (SELECT event_type AS sample, user_id AS experiment, round(avg(value), 9) AS score FROM events GROUP BY 1, 2), b AS (SELECT *, score = max(score) OVER (PARTITION BY sample) AS best FROM r), w AS (SELECT experiment, count(*) FILTER (best) AS wins FROM b GROUP BY 1)
    SELECT sample, experiment, nth FROM (SELECT sample, experiment, row_number() OVER (PARTITION BY sample ORDER BY score DESC, wins DESC, experiment) AS nth FROM b JOIN w USING (experiment)) WHERE nth <= 3""")
def top_experiments(spark, d):
    """Three experiments a sample; ties go to those that win most samples."""
    r = table(spark, d, "events").groupBy(F.col("event_type").alias("sample"), F.col("user_id").alias("experiment")).agg(F.round(F.avg("value"), 9).alias("score"))
    top = r.groupBy("sample").agg(F.max("score").alias("top"))
    wins = r.join(top, "sample").groupBy("experiment").agg(F.count_if(F.col("score") == F.col("top")).alias("wins"))
    w = Window.partitionBy("sample").orderBy(F.desc("score"), F.desc("wins"), "experiment")
    return r.join(wins, "experiment").withColumn("nth", F.row_number().over(w)).filter("nth <= 3").select("sample", "experiment", "nth")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS x FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS x FROM lineitem WHERE l_returnflag = 'R'), na AS (SELECT s, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1), nn AS (SELECT s, count(*) AS n FROM a JOIN b USING (s, x) GROUP BY 1)
    SELECT s, coalesce(nn.n, 0) AS shared, round(coalesce(nn.n, 0) / na.n, 6) AS of_source, round(coalesce(nn.n, 0) / nb.n, 6) AS of_reference FROM na JOIN nb USING (s) LEFT JOIN nn USING (s)""")
def overlap_shares(spark, d):
    """What two sources share, by the size of either."""
    x = table(spark, d, "lineitem").filter("l_returnflag IN ('A', 'R')").groupBy(F.col("l_suppkey").alias("s"), "l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    n = x.groupBy("s").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("shared")).filter("na > 0 AND nb > 0")
    return n.select("s", "shared", F.round(F.col("shared") / F.col("na"), 6).alias("of_source"), F.round(F.col("shared") / F.col("nb"), 6).alias("of_reference"))


@query("""SELECT role, n // 5 AS batch, count(*) AS n_turns, max(length(text)) AS longest, array_to_string(list(turn ORDER BY conv_id, turn, text), ',') AS turns FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS n FROM conversations) GROUP BY 1, 2""")
def prompt_batches(spark, d):
    """Turns of a role in batches of five, in order: the size is the feature. Places come from counts of conversations."""
    c = table(spark, d, "conversations")
    nth = records.numbered(c, ["role"], "conv_id", ["turn", "text"], "n")
    return nth.groupBy("role", F.floor(F.col("n") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("n_turns"), F.max(F.length("text")).alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda x: x["turn"]), ",").alias("turns"))


@query("""SELECT p_partkey, substr(p_type, 1, 4) AS abbr FROM part WHERE substr(p_type, 1, 4) NOT IN (SELECT DISTINCT substr(c_mktsegment, 1, 4) FROM customer UNION SELECT 'ECON')""")
def unsolved_keys(spark, d):
    """Keys that no earlier answer has solved."""
    solved = table(spark, d, "customer").select(F.substring("c_mktsegment", 1, 4).alias("abbr")).union(spark.createDataFrame([("ECON",)], "abbr string")).distinct()
    return table(spark, d, "part").select("p_partkey", F.substring("p_type", 1, 4).alias("abbr")).join(solved, "abbr", "left_anti")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS f, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT f, count(*) AS n, count(*) FILTER (quality = 0) AS wrong FROM w GROUP BY f)
    SELECT f AS feature, n, round(wrong / n, 6) AS rate FROM c WHERE n >= 5 AND wrong / n >= 0.3""")
def worst_features(spark, d):
    """Features predicted often enough and wrong often enough."""
    w = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality IS NOT NULL"), "doc_id").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("feature"), "quality")
    c = w.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("wrong"))
    return c.filter("n >= 5 AND wrong / n >= 0.3").select("feature", "n", F.round(F.col("wrong") / F.col("n"), 6).alias("rate"))


@query("""WITH a AS (SELECT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'), x AS (SELECT id, md5(id::VARCHAR) AS h FROM a JOIN b USING (id) ORDER BY h LIMIT 10), r AS (SELECT id, md5(id::VARCHAR) AS h FROM a WHERE id NOT IN (SELECT id FROM x) ORDER BY h LIMIT 15) SELECT id, true AS shared FROM x UNION ALL SELECT id, false FROM r""")
def overlap_sample(spark, d):
    """25 ids, 10 of them in both sources, the rest by hash: the sizes are the feature."""
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    by = F.md5(F.col("id").cast("string"))
    x = a.join(b, "id").orderBy(by).limit(10).withColumn("shared", F.lit(True))
    return x.union(a.join(F.broadcast(x.select("id")), "id", "left_anti").orderBy(by).limit(15).withColumn("shared", F.lit(False)))


@query(f"""WITH {CATALOGUE}, a AS (SELECT model_id, likes > (SELECT median(likes) FROM catalogue) AS popular, md5(model_id::VARCHAR) AS h FROM catalogue), r AS (SELECT *, row_number() OVER (PARTITION BY popular ORDER BY h) AS nth FROM a), t AS (SELECT model_id, popular, false AS filler FROM r WHERE nth <= 120),
    z AS (SELECT model_id, popular, true AS filler FROM (SELECT * FROM r WHERE nth > 120 ORDER BY h LIMIT (SELECT greatest(0, 240 - count(*)) FROM t))) SELECT * FROM t UNION ALL SELECT * FROM z""")
def balanced_sample_filled(spark, d):
    """120 popular and 120 other records, the shortfall of one filled from what is left: the sizes are the feature."""
    return records.balanced_sample(catalogue(spark, d).select("model_id", "likes"), "model_id", "likes", 120)
