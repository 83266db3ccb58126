"""Queries that assign families, domains and paths, relax searches and fuse rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import families, likeness, ranking, sampling, similarity

from .catalogue import CATALOGUE, CRITERIA, SIGNALS, catalogue, table
from .registry import query


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    p AS (SELECT child AS leaf, parent AS top, parent || '>' || child AS path, 2 AS depth FROM e WHERE child NOT IN (SELECT parent FROM e) UNION ALL SELECT leaf, e.parent, e.parent || '>' || path, depth + 1 FROM p JOIN e ON e.child = p.top)
    SELECT leaf, path, depth FROM p WHERE top NOT IN (SELECT child FROM e)""")
def taxonomy_root_paths(spark, d):
    """From the root to every leaf, however deep."""
    label = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = table(spark, d, "nation").select(label("n", "n_nationkey").alias("child"), label("r", "n_regionkey").alias("parent"))
    edges = edges.union(table(spark, d, "region").select(label("r", "r_regionkey"), F.lit("world"))).union(table(spark, d, "supplier").select(label("s", "s_suppkey"), label("n", "s_nationkey"))).distinct()
    return families.root_paths(edges).select("leaf", F.array_join("path", ">").alias("path"), "depth")


COSINES = """p AS (SELECT label AS proto, list(avg ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS avg FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
    s AS (SELECT vec_id, label, proto, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings, p)"""


def cosines(spark, d):
    """(vec_id, label, proto, score) of every vector and class mean; the means are a small, stated set in one row."""
    v = table(spark, d, "embeddings")
    means = v.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    unit = means.select("label", V.unit(F.col("c")).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("means"))
    one = v.select("vec_id", "label", V.unit(F.col("embedding")).alias("u")).crossJoin(F.broadcast(unit))
    return one.select("vec_id", "label", F.explode(F.transform("means", lambda p: F.struct(p["label"].alias("proto"), F.round(V.dot(F.col("u"), p["c"]), 6).alias("score")))).alias("x")).select("vec_id", "label", "x.proto", "x.score")


@query(f"""WITH {COSINES}, z AS (SELECT vec_id, proto, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) + CASE WHEN proto % 4 = 1 THEN .05 ELSE 0 END AS z, proto = label AS tagged FROM s WINDOW w AS (PARTITION BY vec_id)),
    g AS (SELECT vec_id, max(z) FILTER (k = 1) - max(z) FILTER (k = 2) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, proto DESC) AS k FROM z) GROUP BY 1),
    f AS (SELECT vec_id, proto, z + CASE WHEN gap < .03 AND tagged THEN .08 ELSE 0 END AS z, gap FROM z JOIN g USING (vec_id))
    SELECT vec_id, arg_max(proto, (z, proto)) AS domain, round(max(z), 4) AS z, round(any_value(gap), 4) AS margin FROM f GROUP BY vec_id""")
def domain_assign(spark, d):
    """Cosines to prototypes as z-scores, boosted for some; near ties go to the tagged one."""
    s = cosines(spark, d).select("vec_id", F.col("proto").alias("candidate"), "score", F.when(F.col("proto") % 4 == 1, 0.05).otherwise(0.0).alias("boost"), (F.col("proto") == F.col("label")).alias("tagged"))
    return families.assigned(s, "vec_id", 0.03, 0.08).select("vec_id", F.col("candidate").alias("domain"), F.round("z", 4).alias("z"), F.round("margin", 4).alias("margin"))


#: Lexical boost of a path for a text: .10 for each segment that it holds whole, .03 for each shared word up to .18, .28 at most.
@query("""WITH p AS (SELECT p_type || '/' || string_split(p_name, ' ')[1] AS path, lower(p_type) AS a, string_split(p_name, ' ')[1] AS b, avg(p_retailprice) AS price FROM part GROUP BY ALL), t AS (SELECT p_partkey, lower(p_type) || ' ' || p_name AS text, string_split(p_name, ' ')[1] AS key, p_retailprice AS x FROM part),
    c AS (SELECT p_partkey, path, 1 - abs(x - price) / 2000 AS score, least(.28, .10 * (contains(text, a)::INT + contains(text, b)::INT) + least(.18, .03 * len(list_intersect(string_split(text, ' '), [a, b])))) AS boost FROM t JOIN p ON key = b),
    z AS (SELECT p_partkey, path, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) + boost AS z FROM c WINDOW w AS (PARTITION BY p_partkey))
    SELECT p_partkey, arg_max(path, (round(z, 9), path)) AS path, round(max(z), 4) AS z FROM z GROUP BY p_partkey""")
def taxonomy_assign(spark, d):
    """The path of a taxonomy for a record: candidates share a word, then z-score and lexical boost."""
    part = table(spark, d, "part").withColumn("first", F.substring_index("p_name", " ", 1))
    p = part.groupBy("p_type", "first").agg(F.avg("p_retailprice").alias("price")).select(F.concat_ws("/", "p_type", "first").alias("candidate"), F.lower("p_type").alias("a"), F.col("first").alias("b"), "price")
    t = part.select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name").alias("text"), F.col("first").alias("b"), "p_retailprice")
    segments = F.contains("text", F.col("a")).cast("int") + F.contains("text", F.col("b")).cast("int")
    words = F.size(F.array_intersect(F.split("text", " "), F.array("a", "b")))
    s = t.join(p, "b").select("p_partkey", "candidate", (1 - F.abs(F.col("p_retailprice") - F.col("price")) / 2000).alias("score"), F.least(F.lit(0.28), 0.10 * segments + F.least(F.lit(0.18), 0.03 * words)).alias("boost"), F.lit(False).alias("tagged"))
    means = s.groupBy("p_partkey").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("score") - F.col("m")) / F.col("sd")).otherwise(0.0) + F.col("boost")
    return s.join(means, "p_partkey").groupBy("p_partkey").agg(F.max_by("candidate", F.struct(F.round(z, 9), "candidate")).alias("path"), F.round(F.max(z), 4).alias("z"))


@query("""SELECT p_partkey, CASE WHEN (contains(t, 'image') OR contains(t, 'ring')) AND (contains(t, 'text') OR contains(t, 'economy')) THEN 'multimodal' WHEN contains(t, 'ring') THEN 'image' WHEN contains(t, 'economy') THEN 'text' WHEN contains(t, 'gizmo') THEN 'audio' ELSE 'other' END AS modality, contains(t, 'promo') AND NOT contains(t, 'small') AS generative FROM (SELECT p_partkey, lower(p_type) || ' ' || p_name AS t FROM part)""")
def modality_route(spark, d):
    """Words decide the modality, two of them make it multimodal."""
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains("t", F.lit(x)) for x in w])
    image, text = has("image", "ring"), has("text", "economy")
    m = F.when(image & text, "multimodal").when(has("ring"), "image").when(has("economy"), "text").when(has("gizmo"), "audio").otherwise("other")
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name").alias("t")).select("p_partkey", m.alias("modality"), (has("promo") & ~has("small")).alias("generative"))


FAMILY = """s AS (SELECT p_partkey, p_partkey // 10 AS base, p_type, p_name, p_brand, .5 * contains(p_name, 'ring')::INT + .65 * (p_type = 'PROMO')::INT + .18 * contains(p_name, 'small')::INT AS ring, .5 * contains(p_name, 'bolt')::INT + .65 * (p_type = 'LARGE')::INT + .18 * contains(p_name, 'red')::INT AS bolt, .5 * contains(p_name, 'gear')::INT + .65 * (p_type = 'MEDIUM')::INT + .18 * contains(p_name, 'blue')::INT AS gear FROM part),
    o AS (SELECT p_partkey, base, CASE WHEN p_type = 'ECONOMY' AND p_brand = 'Brand#1' THEN 'economy' WHEN contains(p_name, 'tiny') THEN 'tiny' WHEN ring >= .28 AND ring - greatest(bolt, gear) >= .08 THEN 'ring' WHEN bolt >= .28 AND bolt - greatest(ring, gear) >= .08 THEN 'bolt' WHEN gear >= .28 AND gear - greatest(ring, bolt) >= .08 THEN 'gear' END AS family,
      CASE WHEN p_type = 'ECONOMY' AND p_brand = 'Brand#1' THEN 'hint' WHEN contains(p_name, 'tiny') THEN 'pattern' ELSE 'alias' END AS rule FROM s),
    h AS (SELECT a.p_partkey, a.base, coalesce(a.family, b.family) AS family, CASE WHEN a.family IS NOT NULL THEN 0 WHEN b.family IS NOT NULL THEN 1 END AS hop, a.rule FROM o a LEFT JOIN o b ON b.p_partkey = a.base), i AS (SELECT a.p_partkey, coalesce(a.family, b.family) AS family, CASE WHEN a.hop IS NOT NULL THEN a.hop WHEN b.family IS NOT NULL THEN 2 END AS hop, a.rule FROM h a LEFT JOIN h b ON b.p_partkey = a.base)"""


@query(f"""WITH {FAMILY} SELECT p_partkey, coalesce(family, 'Other / Unclear') AS family, CASE WHEN family IS NULL THEN 'none' WHEN hop > 0 THEN 'inherited' ELSE rule END AS rule, CASE WHEN family IS NULL THEN 0 WHEN hop > 0 THEN .85 WHEN rule = 'hint' THEN .93 WHEN rule = 'pattern' THEN .97 ELSE .80 END::DOUBLE AS confidence FROM i""")
def family_assign(spark, d):
    """Hint, pattern and alias scores in turn, then the family of the base, or of its base; else unclear."""
    has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    score = lambda name, kind, text: 0.5 * has(name) + 0.65 * (F.col("p_type") == kind).cast("int") + 0.18 * has(text)
    hint = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#1"), "economy")
    alias = families.alias_choice({"ring": score("ring", "PROMO", "small"), "bolt": score("bolt", "LARGE", "red"), "gear": score("gear", "MEDIUM", "blue")}, 0.28, 0.08)
    own = families.cascade([("hint", hint, 0.93), ("pattern", F.when(has("tiny") > 0, "tiny"), 0.97), ("alias", alias, 0.80)])
    p = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("base"), own.alias("x")).select("p_partkey", "base", "x.confidence", "x.rule", F.when(F.col("x.rule") != "none", F.col("x.family")).alias("family"))
    i = families.inherited(p, "p_partkey", "base", "family")
    took = F.col("hop") > 0
    return i.select("p_partkey", F.coalesce("family", F.lit(families.UNCLEAR)).alias("family"), F.when(F.col("family").isNull(), "none").when(took, "inherited").otherwise(F.col("rule")).alias("rule"), F.when(F.col("family").isNull(), 0.0).when(took, 0.85).otherwise(F.col("confidence")).alias("confidence"))


@query("""WITH t AS (SELECT p_partkey AS model, unnest(string_split(p_name, ' ')) AS root, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS place, (p_partkey % 3 = 0)::INT AS from_base, p_type AS kind FROM part), k AS (SELECT root, kind, count(*) AS k FROM t GROUP BY 1, 2), c AS (SELECT root, count(*) AS n_kinds, max(k) / sum(k) AS coherence FROM k GROUP BY 1)
    SELECT root, count(*) AS n, round(avg(from_base), 6) AS hit_rate, median(place) AS place, n_kinds, round(coherence, 6) AS coherence, count(*) >= 10 AND avg(from_base) >= .3 AND median(place) <= 1 AND coherence >= .15 AND n_kinds < 8 AS promoted FROM t JOIN c USING (root) GROUP BY root, n_kinds, coherence""")
def family_roots(spark, d):
    """Words of names that may stand for a family, and which of them pass every test."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("model"), F.posexplode(F.split("p_name", " ")).alias("place", "root"), (F.col("p_partkey") % 3 == 0).cast("int").alias("from_base"), F.col("p_type").alias("kind")).withColumn("place", F.col("place") + 1)
    return families.discovered(t, 10, 0.3, 1, 0.15, 8).select("root", "n", F.round("hit_rate", 6).alias("hit_rate"), "place", "n_kinds", F.round("coherence", 6).alias("coherence"), "promoted")


@query("""WITH i AS (SELECT o_orderkey AS intent, CASE o_orderpriority WHEN '1-URGENT' THEN 1.6 WHEN '2-HIGH' THEN 1.3 WHEN '5-LOW' THEN 0 ELSE 1.0 END AS m, c_mktsegment AS task, n_name AS domain FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT intent, 'task' AS field, task AS term, round(2.0 * m, 4)::DOUBLE AS boost FROM i UNION ALL SELECT intent, 'task', lower(task), round(2.0 * m * .85, 4)::DOUBLE FROM i UNION ALL SELECT intent, 'domain', domain, round(1.0 * m, 4)::DOUBLE FROM i UNION ALL SELECT intent, 'domain', replace(domain, '_', ' '), round(1.0 * m * .9, 4)::DOUBLE FROM i""")
def intent_criteria(spark, d):
    """A row for each term of each user's intent: weight by priority, aliases weaker."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    p = F.col("o_orderpriority")
    m = F.when(p == "1-URGENT", ranking.PRIORITY["must"]).when(p == "2-HIGH", ranking.PRIORITY["strong_prefer"]).when(p == "5-LOW", ranking.PRIORITY["avoid"]).otherwise(ranking.PRIORITY["prefer"])
    task, domain = F.col("c_mktsegment"), F.col("n_name")
    terms = [("task", task, 2.0, 1.0), ("task", F.lower(task), 2.0, 0.85), ("domain", domain, 1.0, 1.0), ("domain", F.replace(domain, F.lit("_"), F.lit(" ")), 1.0, 0.9)]
    rows = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("term"), F.round(m * w * k, 4).alias("boost")) for f, t, w, k in terms))
    return o.select(F.col("o_orderkey").alias("intent"), F.explode(rows).alias("x")).select("intent", "x.*")


@query("""SELECT 'type' AS field, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'word', w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 2""")
def alias_vocabulary(spark, d):
    """Distinct values of fields and of lists, with their counts, in one pass."""
    cells = F.concat(F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")), F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value"))), F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("word").alias("field"), w.alias("value"))))
    return table(spark, d, "part").select(F.explode(cells).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CATALOGUE}, l AS (SELECT *, CASE WHEN list_contains(features, 'red') AND likes > 40 AND p_size < 3 THEN 0 WHEN likes > 40 AND p_size < 3 THEN 1 WHEN likes > 40 THEN 2 ELSE 3 END AS level FROM catalogue WHERE task = 'ECONOMY'), n AS (SELECT unnest([0, 1, 2, 3]) AS n), c AS (SELECT n, (SELECT count(*) FROM l WHERE level <= n) AS hits FROM n), k AS (SELECT coalesce(min(n) FILTER (hits >= 20), 3) AS k FROM c)
    SELECT model_id, level, likes FROM l, k WHERE level <= k ORDER BY level, likes DESC, model_id LIMIT 30""")
def rank_relaxed_rows(spark, d):
    """Filters given up in order of bucket, priority and weight until 20 rows hold; rows by the level they come in at."""
    filters = [("size", F.col("p_size") < 3, 1, "strong_prefer", 0.5), ("likes", F.col("likes") > 40, 1, "must", 0.4), ("red", F.array_contains("features", "red"), 0, "must", 2.0)]
    chosen, rows = families.relaxed(catalogue(spark, d), F.col("task") == "ECONOMY", filters, 20)
    return rows.filter(F.col("level") <= chosen).orderBy("level", F.desc("likes"), "model_id").limit(30).select("model_id", "level", "likes")


@query(f"""WITH {CATALOGUE}, s AS (SELECT model_id, CASE WHEN task = 'ECONOMY' THEN 3.2e0 WHEN task = 'PROMO' THEN 3.2e0 * 0.85e0 ELSE 0e0 END AS a, CASE WHEN list_contains(features, 'small') THEN 1.3e0 WHEN list_contains(features, 'tiny') THEN 1.3e0 * 0.8e0 ELSE 0e0 END AS b, CASE WHEN list_contains(features, 'ring') THEN 1.5e0 WHEN list_contains(features, 'widget') THEN 1.5e0 * 0.64e0 ELSE 0e0 END AS c, least(0.5e0 * log10(1 + likes) + 0.25e0 * log10(1 + downloads), 1.5e0) AS g FROM catalogue),
    r AS (SELECT model_id, a + b + c + g AS x, 5e0 AS w, 1 AS k FROM s WHERE a + b + c > 0 UNION ALL SELECT model_id, a + g, 4e0, 2 FROM s WHERE a > 0 UNION ALL SELECT model_id, b + c + g, 1.5e0, 3 FROM s WHERE b + c > 0 UNION ALL SELECT model_id, c + g, .75e0, 4 FROM s WHERE c > 0), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, model_id) AS n FROM r)
    SELECT model_id, round(sum(w / (60 + n)), 8) AS score FROM t WHERE n <= 100 GROUP BY model_id ORDER BY score DESC, model_id LIMIT 20""")
def rank_hybrid_strategies(spark, d):
    """Four strategies that mask some criteria, each its top 100, fused by weighted reciprocal ranks."""
    docs, (economy, small, ring, _) = catalogue(spark, d), CRITERIA
    parts = []
    for criteria, weight in (([economy, small, ring], 5.0), ([economy], 4.0), ([small, ring], 1.5), ([ring], 0.75)):
        top = ranking.rank(docs, criteria, SIGNALS, minimum=1, k=100)
        parts.append((top.select("model_id", F.row_number().over(Window.orderBy(F.desc("score"), "model_id")).alias("rank")), weight))  # over 100 rows
    return ranking.fuse(parts).select("model_id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "model_id").limit(20)


@query("""WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), ' ') || ' ' AS t, lang, source FROM documents), s AS (SELECT doc_id, greatest(CASE WHEN lang = 'en' THEN 1.15 ELSE 0 END, CASE WHEN contains(t, ' of the ') THEN 1.10 ELSE 0 END, CASE WHEN contains(t, ' of ') AND contains(t, ' the ') THEN 1.0 ELSE 0 END) AS s, CASE WHEN contains(t, ' of the ') THEN 1.0 WHEN contains(t, ' of ') THEN .85 WHEN contains(t, ' the ') THEN .70 ELSE 0 END AS tier FROM t)
    SELECT doc_id, s::DOUBLE AS value_score, round(2 * tier, 6)::DOUBLE AS tier_boost FROM s WHERE s > 0 OR tier > 0""")
def text_tiers(spark, d):
    """The best of exact field, phrase and all words of a value; a boost by how surely a text matches."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    t = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("t"))
    has = lambda w: F.contains("t", F.lit(f" {w} "))
    value = F.greatest(F.when(F.col("lang") == "en", 1.15).otherwise(0.0), F.when(has("of the"), 1.10).otherwise(0.0), F.when(has("of") & has("the"), 1.0).otherwise(0.0))
    tier = F.when(has("of the"), 1.0).when(has("of"), 0.85).when(has("the"), 0.70).otherwise(0.0)
    return t.select("doc_id", value.alias("value_score"), F.round(2 * tier, 6).alias("tier_boost")).filter("value_score > 0 OR tier_boost > 0")


@query("""SELECT p_partkey, lower((p_size > 25)::VARCHAR) = 'true' AS gated, round((.7 * (contains(p_name, 'ring')::INT + contains(p_name, 'small')::INT) + (p_type = 'PROMO')::INT), 6)::DOUBLE AS special, len(list_intersect(string_split(p_name, ' '), ['ring', 'bolt', 'red'])) > 0 AS in_set FROM part""")
def special_matches(spark, d):
    """Flags compared in lower case, weaker boosts for inferred matches, records that share a feature with a set."""
    has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    return table(spark, d, "part").select("p_partkey", (F.lower((F.col("p_size") > 25).cast("string")) == "true").alias("gated"), F.round(0.7 * (has("ring") + has("small")) + (F.col("p_type") == "PROMO").cast("int"), 6).alias("special"), F.arrays_overlap(F.split("p_name", " "), F.array(*map(F.lit, ("ring", "bolt", "red")))).alias("in_set"))


@query("""WITH a AS (SELECT list_sort(list(DISTINCT p_type)) AS t, list_sort(list(DISTINCT p_brand)) AS b, list_sort(list(DISTINCT p_size)) AS s FROM part), h AS (SELECT range AS nth, md5('7:' || range) AS h FROM range(40))
    SELECT min(nth) AS nth, p_type, p_brand, p_size FROM (SELECT nth, t[('0x' || substr(h, 1, 4))::INT % len(t) + 1] AS p_type, b[('0x' || substr(h, 5, 4))::INT % len(b) + 1] AS p_brand, s[('0x' || substr(h, 9, 4))::INT % len(s) + 1] AS p_size FROM h, a) GROUP BY ALL""")
def random_configs(spark, d):
    """40 draws of a type, a brand and a size that records have, each combination once: the number is the feature."""
    return sampling.random_points(table(spark, d, "part"), ["p_type", "p_brand", "p_size"], 40, 7)


@query()
def phrase_match_reasons(spark, d):
    """All pairs of names that share half of their three-letter pieces, with why they are one: likeness has no SQL."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("name") + 2), lambda i: F.substring(F.concat(F.lit("##"), F.lower("name"), F.lit("##")), i, F.lit(3)))
    of = similarity.members(names.select("name", grams.alias("items")), "name", "items")
    alike = of.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    pairs = similarity.similar_pairs(of, 0.5).select("a", "b").union(alike)
    return likeness.compared(pairs, "a", "b").select("a", "b", *(F.round(c, 9).alias(c) for c in ("ratio", "indel", "weighted", "score")), "reason")
