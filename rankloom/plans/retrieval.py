"""Further retrieval, shaping and text queries of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import dedupe, ranking

from .catalogue import CATALOGUE, CRITERIA, catalogue, table
from .registry import query

WORDS4 = "[A-Za-z]{4,}"


# ---- ranking variants

@query(f"""WITH {CATALOGUE}, s AS (SELECT model_id,
    CASE WHEN task = 'ECONOMY' THEN 3.2e0 ELSE 0e0 END + CASE WHEN task = 'PROMO' THEN 3.2e0 * 0.85e0 ELSE 0e0 END
    + CASE WHEN list_contains(features, 'small') THEN 1.3e0 ELSE 0e0 END + CASE WHEN list_contains(features, 'tiny') THEN 1.3e0 * 0.8e0 ELSE 0e0 END
    + CASE WHEN list_contains(features, 'ring') THEN 1.5e0 ELSE 0e0 END + CASE WHEN list_contains(features, 'widget') THEN 1.5e0 * 0.64e0 ELSE 0e0 END
    + CASE WHEN author = 'Brand#2' OR list_contains(tags, 'Brand#2') THEN 1e0 ELSE 0e0 END + CASE WHEN author = 'Brand#4' OR list_contains(tags, 'Brand#4') THEN 0.9e0 ELSE 0e0 END AS score FROM catalogue)
    SELECT model_id, round(score, 5) AS score FROM s WHERE score > 0 ORDER BY round(score, 5) DESC, model_id LIMIT 20""")
def rank_term_bucketed(spark, d):
    """Every matched term counts once, whichever value asked for it."""
    docs = catalogue(spark, d)
    each = [ranking.match_score(docs, ranking.Criterion(t, c.fields, ((t, f),), c.weight, c.priority)) for c in CRITERIA for t, f in c.terms]
    return docs.select("model_id", F.round(sum(each, F.lit(0.0)), 5).alias("score")).filter("score > 0").orderBy(F.desc("score"), "model_id").limit(20)


@query(f"""WITH {CATALOGUE}, a AS (SELECT model_id, row_number() OVER (ORDER BY likes DESC, model_id) AS r FROM catalogue ORDER BY r LIMIT 100),
    b AS (SELECT model_id, row_number() OVER (ORDER BY p_retailprice DESC, model_id) AS r FROM catalogue ORDER BY r LIMIT 300)
    SELECT model_id, round(sum(w), 8) AS score, count(*) AS n_rankings FROM (SELECT model_id, 1e0 / (60 + r) AS w FROM a UNION ALL SELECT model_id, 0.75e0 / (60 + r) FROM b WHERE model_id IN (SELECT model_id FROM a)) GROUP BY model_id""")
def rank_gated_rrf(spark, d):
    """Fusion in which only candidates of the first ranking may score."""
    docs = catalogue(spark, d)
    a = ranking.ranked(docs, [F.desc("likes"), F.col("model_id")], 100)
    b = ranking.ranked(docs, [F.desc("p_retailprice"), F.col("model_id")], 300).join(a.select("model_id"), "model_id", "left_semi")
    both = reduce(DataFrame.unionByName, [r.select("model_id", (F.lit(w) / (60 + F.col("rank"))).alias("w")) for r, w in ((a, 1.0), (b, 0.75))])
    return both.groupBy("model_id").agg(F.round(F.sum("w"), 8).alias("score"), F.count(F.lit(1)).alias("n_rankings"))


@query(f"""WITH {CATALOGUE}, g AS (SELECT * FROM (VALUES (0, 1e0, 1e0), (1, 1.8e0, 1e0), (2, 1.4e0, 0.5e0), (3, 1e0, 2e0)) v(config, task_weight, feature_weight)),
    s AS (SELECT config, model_id, task_weight * (task = 'ECONOMY')::INT + feature_weight * (list_contains(features, 'ring')::INT + list_contains(features, 'small')::INT) AS score FROM catalogue, g)
    SELECT config, count(*) FILTER (score > 0) AS n_hits, round(max(score), 6) AS best_score, arg_min(model_id, (-score, model_id)) AS best FROM s GROUP BY config""")
def grid_all_configs(spark, d):
    """All weightings of an experiment grid in one pass over the catalogue: the grid is a literal array."""
    grid = F.array(*(F.struct(F.lit(i).alias("config"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(1.0, 1.0), (1.8, 1.0), (1.4, 0.5), (1.0, 2.0)])))
    docs = catalogue(spark, d)
    hits = docs.select("model_id", (F.col("task") == "ECONOMY").cast("int").alias("t"), (F.array_contains("features", "ring").cast("int") + F.array_contains("features", "small").cast("int")).alias("f"), F.explode(grid).alias("g"))
    scored = hits.select("g.config", "model_id", (F.col("g.a") * F.col("t") + F.col("g.b") * F.col("f")).alias("score"))
    return scored.groupBy("config").agg(F.count_if(F.col("score") > 0).alias("n_hits"), F.round(F.max("score"), 6).alias("best_score"), F.min_by("model_id", F.struct(-F.col("score"), F.col("model_id"))).alias("best"))


@query(f"""WITH {CATALOGUE}, c AS (SELECT count(*) FILTER (task = 'ECONOMY') AS task_must, count(*) FILTER (task IN ('ECONOMY', 'PROMO')) AS task_relaxed,
      count(*) FILTER (p_size < 5) AS size_must, count(*) FILTER (p_size < 10) AS size_relaxed, count(*) FILTER (likes > 35) AS likes_must, count(*) FILTER (likes > 25) AS likes_relaxed FROM catalogue)
    SELECT split_part(k, '_', 1) AS criterion, split_part(k, '_', 2) AS mode, n FROM c UNPIVOT (n FOR k IN (task_must, task_relaxed, size_must, size_relaxed, likes_must, likes_relaxed))""")
def rank_feasibility(spark, d):
    """Hits of every criterion, strict and relaxed: one aggregate instead of a search each."""
    c = {"task_must": F.col("task") == "ECONOMY", "task_relaxed": F.col("task").isin("ECONOMY", "PROMO"), "size_must": F.col("p_size") < 5, "size_relaxed": F.col("p_size") < 10, "likes_must": F.col("likes") > 35, "likes_relaxed": F.col("likes") > 25}
    long = catalogue(spark, d).agg(*(F.count_if(x).alias(k) for k, x in c.items())).unpivot([], list(c), "k", "n")
    return long.select(F.split_part("k", F.lit("_"), F.lit(1)).alias("criterion"), F.split_part("k", F.lit("_"), F.lit(2)).alias("mode"), "n")


@query(f"""WITH {CATALOGUE} SELECT model_id, round(exp(ln(0.5e0) * pow(greatest(date_diff('day', last_modified::DATE, DATE '2001-01-01'), 0) / 365e0, 2)), 6) AS decay FROM catalogue WHERE last_modified IS NOT NULL""")
def recency_decay(spark, d):
    """Gaussian decay of the age, half at a year."""
    age = F.greatest(F.date_diff(F.lit("2001-01-01").cast("date"), F.col("last_modified").cast("date")), F.lit(0)) / 365.0
    return catalogue(spark, d).filter("last_modified IS NOT NULL").select("model_id", F.round(F.exp(F.log(F.lit(0.5)) * F.pow(age, F.lit(2.0))), 6).alias("decay"))


@query(f"""WITH {CATALOGUE}, m AS (SELECT median(likes) AS likes, median(p_retailprice) AS price FROM catalogue)
    SELECT model_id, CASE WHEN c.likes > m.likes AND p_retailprice > m.price THEN 'all-rounder' WHEN p_retailprice > m.price THEN 'underrated' WHEN c.likes > m.likes THEN 'popular' ELSE 'other' END AS stratum FROM catalogue c, m""")
def popularity_strata(spark, d):
    """Median splits: well used and high in value, high in value but little used, the reverse, neither."""
    docs = catalogue(spark, d)
    likes, price = (docs.agg(F.median(c)).scalar() for c in ("likes", "p_retailprice"))
    s = docs.select("model_id", (F.col("likes") > likes).alias("l"), (F.col("p_retailprice") > price).alias("p"))
    return s.select("model_id", F.when(F.col("l") & F.col("p"), "all-rounder").when(F.col("p"), "underrated").when(F.col("l"), "popular").otherwise("other").alias("stratum"))


@query(f"""WITH {CATALOGUE} SELECT model_id, (list_contains(string_split('small ring', ' '), features[1])::INT + list_contains(string_split('small ring', ' '), features[2])::INT) / 2e0 AS token_ratio, array_to_string(features || [task, author], ' ') LIKE '%ring%ECONOMY%' AS phrase FROM catalogue""")
def cross_field_match(spark, d):
    """Share of the query's tokens found in any field, and a phrase over the fields laid end to end."""
    wanted = F.split(F.lit("small ring"), " ")
    both = F.array_join(F.concat("features", F.array("task", "author")), " ")
    ratio = F.size(F.filter("features", lambda x: F.array_contains(wanted, x))) / F.lit(2.0)
    return catalogue(spark, d).select("model_id", ratio.alias("token_ratio"), both.like("%ring%ECONOMY%").alias("phrase"))


# ---- records and sets

@query("""SELECT o_custkey AS id FROM orders INTERSECT SELECT s_suppkey FROM supplier""")
def set_intersection(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("""SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey::VARCHAR FROM supplier""")
def union_missing_columns(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def dedupe_keep_last(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return dedupe.best_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT o_orderkey, coalesce(o_orderpriority, '') AS priority, n_name, coalesce(r_name, 'none') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_chain(spark, d):
    """A chain of left look-ups with a fallback; Spark broadcasts the sides it measures as small."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(n.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("priority"), "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("""SELECT n_name, sum(F) AS F, sum(O) AS O, sum(P) AS P FROM (SELECT n_name, (o_orderstatus = 'F')::INT AS F, (o_orderstatus = 'O')::INT AS O, (o_orderstatus = 'P')::INT AS P FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_name""".replace("sum(F)", "sum(F)::BIGINT").replace("sum(O)", "sum(O)::BIGINT").replace("sum(P)", "sum(P)::BIGINT"))
def join_outer_wide(spark, d):
    """Rows a source made columns a source."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("n")).fillna(0)


@query("""SELECT l_partkey, metric, value FROM (SELECT l_partkey, round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY l_partkey) UNPIVOT (value FOR metric IN (quantity, price, discount))""")
def unpivot_metrics(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 4).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_discount"), 4).alias("discount"))
    return g.unpivot(["l_partkey"], ["quantity", "price", "discount"], "metric", "value")


@query("""SELECT feature, count(*) AS n_models, count(DISTINCT p_type) AS n_tasks, count(DISTINCT p_brand) AS n_authors FROM (SELECT DISTINCT p_partkey, p_type, p_brand, unnest(string_split(p_name, ' ')) AS feature FROM part) GROUP BY feature HAVING count(*) >= 20 AND count(DISTINCT p_brand) >= 5""")
def feature_thresholds(spark, d):
    """Features kept by number of models, tasks and authors."""
    f = table(spark, d, "part").select("p_type", "p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("feature"))
    return f.groupBy("feature").agg(F.count(F.lit(1)).alias("n_models"), F.count_distinct("p_type").alias("n_tasks"), F.count_distinct("p_brand").alias("n_authors")).filter("n_models >= 20 AND n_authors >= 5")


# ---- knowledge graph and families

@query("""SELECT 'feature:' || f AS node, 'feature' AS kind, count(*) AS degree FROM (SELECT unnest(string_split(p_name, ' ')) AS f FROM part) GROUP BY f UNION ALL SELECT 'task:' || p_type, 'task', count(*) FROM part GROUP BY p_type UNION ALL SELECT 'author:' || p_brand, 'author', count(*) FROM part GROUP BY p_brand""")
def kg_nodes(spark, d):
    pairs = F.concat(F.transform(F.split("p_name", " "), lambda x: F.struct(F.lit("feature").alias("kind"), x.alias("name"))), F.array(F.struct(F.lit("task").alias("kind"), F.col("p_type").alias("name")), F.struct(F.lit("author").alias("kind"), F.col("p_brand").alias("name"))))
    return table(spark, d, "part").select(F.explode(pairs).alias("e")).groupBy(F.concat_ws(":", "e.kind", "e.name").alias("node"), F.col("e.kind").alias("kind")).agg(F.count(F.lit(1)).alias("degree"))


@query("""WITH f AS (SELECT p_partkey, p_brand, string_split(p_name, ' ')[i] AS feature, i::INT AS position FROM part, range(1, 3) t(i)), n AS (SELECT p_brand, feature, count(*) AS shared FROM f GROUP BY 1, 2)
    SELECT p_partkey, feature, shared FROM (SELECT f.p_partkey, feature, shared, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, position) AS r FROM f JOIN n USING (p_brand, feature)) WHERE r = 1""")
def kg_top_features(spark, d):
    """A record's most shared feature within its cluster; ties by original order. Counts are joined, not windowed over a whole cluster."""
    f = table(spark, d, "part").select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("position", "feature"))
    n = f.groupBy("p_brand", "feature").agg(F.count(F.lit(1)).alias("shared"))
    return dedupe.best_per_group(f.join(n, ["p_brand", "feature"]), ["p_partkey"], [F.desc("shared"), F.col("position")]).select("p_partkey", "feature", "shared")


@query("""WITH s AS (SELECT DISTINCT p_name AS name, p_type FROM part WHERE p_type IN ('ECONOMY', 'PROMO')), b AS (SELECT name, min(p_type) AS family FROM s GROUP BY name)
    SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE coalesce(family, 'Other') END AS family, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'own' WHEN family IS NOT NULL THEN 'inherited' ELSE 'none' END AS source FROM part LEFT JOIN b ON p_name = name""")
def family_inherit(spark, d):
    """A record without a family takes that of records of its normal name."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    own = F.col("p_type").isin("ECONOMY", "PROMO")
    base = p.filter(own).groupBy("p_name").agg(F.min("p_type").alias("family"))
    return p.join(base, "p_name", "left").select("p_partkey", F.when(own, F.col("p_type")).otherwise(F.coalesce("family", F.lit("Other"))).alias("family"), F.when(own, "own").when(F.col("family").isNotNull(), "inherited").otherwise("none").alias("source"))


@query("""SELECT token, n, n_tasks, round(first_share, 6) AS first_share FROM (SELECT token, count(*) AS n, count(DISTINCT p_type) AS n_tasks, avg((position = 1)::INT) AS first_share FROM (SELECT p_type, string_split(p_name, ' ')[i] AS token, i AS position FROM part, range(1, 3) t(i)) WHERE token IS NOT NULL GROUP BY token) WHERE n >= 10 AND first_share >= 0.35""")
def family_discovery(spark, d):
    """Candidate family roots: frequent name tokens that mostly stand first."""
    f = table(spark, d, "part").select("p_type", F.posexplode(F.split("p_name", " ")).alias("position", "token"))
    g = f.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("n_tasks"), F.avg((F.col("position") == 0).cast("int")).alias("first_share"))
    return g.filter("n >= 10 AND first_share >= 0.35").withColumn("first_share", F.round("first_share", 6))


TASKS = {"ECONOMY": ("text", "generation"), "PROMO": ("image", "classification"), "STANDARD": ("audio", "recognition")}


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'text' WHEN 'PROMO' THEN 'image' WHEN 'STANDARD' THEN 'audio' ELSE 'other' END AS modality, CASE p_type WHEN 'ECONOMY' THEN 'generation' WHEN 'PROMO' THEN 'classification' WHEN 'STANDARD' THEN 'recognition' ELSE 'other' END AS task_group FROM part""")
def modality_task_assign(spark, d):
    maps = [F.create_map(*(F.lit(x) for k, v in TASKS.items() for x in (k, v[i]))) for i in (0, 1)]
    return table(spark, d, "part").select("p_partkey", *(F.coalesce(F.element_at(m, F.col("p_type")), F.lit("other")).alias(n) for m, n in zip(maps, ("modality", "task_group"))))


# ---- text

@query(f"""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{WORDS4}'))) AS phrase FROM documents), f AS (SELECT phrase, count(*) AS df FROM w GROUP BY phrase)
    SELECT phrase, df FROM f WHERE df >= 3 AND df <= 0.2e0 * (SELECT count(*) FROM documents) AND length(phrase) BETWEEN 4 AND 20""")
def phrase_df_band_filter(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.filter((F.col("df") >= 3) & F.length("phrase").between(4, 20)).withColumn("n", total.scalar()).filter(F.col("df") <= 0.2 * F.col("n")).drop("n")


@query("""SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: length(trim(x)) > 0)) AS n_kept, len(list_distinct(list_filter(l, lambda x: length(trim(x)) > 0))) AS n_distinct FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def text_clean_lines(spark, d):
    full = F.filter("l", lambda x: F.length(F.trim(x)) > 0)
    return table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.size("l").alias("n_lines"), F.size(full).alias("n_kept"), F.size(F.array_distinct(full)).alias("n_distinct"))


@query("""SELECT doc_id, array_to_string((regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+'))[1:50], ' ')[1:400] AS head FROM documents""")
def text_head(spark, d):
    """The first 50 words, at most 400 characters: a display column, the text itself stays whole."""
    w = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0B\x0C]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.substring(F.array_join(F.slice(w, 1, 50), " "), 1, 400).alias("head"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE coalesce(lang, 'unknown') END AS language FROM documents""")
def language_resolve(spark, d):
    names = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("lang")), F.col("lang"), F.lit("unknown")).alias("language"))


@query("""SELECT conv_id, turn, role, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r\\x0b\\x0c]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0 AND contains(lower(x), 'the'))) AS n_mentions FROM conversations""")
def mention_filter(spark, d):
    """Sentences of each turn that mention a name, without regard to case."""
    s = F.filter(X.sentences(F.col("text")), lambda x: F.contains(F.lower(x), F.lit("the")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(s).alias("n_mentions"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, event_type AS "type", round(value, 4) AS value FROM events""")
def json_merge(spark, d):
    """A JSON payload merged over defaults."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1))
    return table(spark, d, "events").select("event_id", k.alias("k"), F.col("event_type").alias("type"), F.round("value", 4).alias("value"))


# ---- windows over events

@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM events""")
def events_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("recent"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))
