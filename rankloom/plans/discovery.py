"""Queries that search by combinations: filters given up by what they bring, trios of records, JSON without a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import open_json as J
from rankloom.operators import relaxation, trios

from .catalogue import CATALOGUE, catalogue, table
from .registry import query

# ---- relaxation

TARGET = 40


def wishes():
    """A task that may be another one but not left out, a brand that no record has, few sizes, more likes than any record has."""
    return [
        relaxation.Group("task", (F.col("task") == "ECONOMY", F.col("task") == "PROMO"), "must", 10.0, relaxable=False),
        relaxation.Group("brand", (F.col("author") == "Brand#0", F.col("author").isin("Brand#1", "Brand#2")), "strong_prefer", 2.0),
        relaxation.Group("size", (F.col("p_size") < 3, F.col("p_size") < 12), "must", 1.0),
        relaxation.Group("likes", (F.col("likes") > 1_000_000, F.col("likes") > 33), "must", 0.5),
        relaxation.Group("ring", (F.array_contains("features", "ring"),), "prefer", 3.0),
    ]


#: Each record's level in each group; the guided steps (from 0); how many of them count.
GUIDED = f"""WITH RECURSIVE {CATALOGUE}, l AS MATERIALIZED (SELECT model_id, likes, CASE WHEN task = 'ECONOMY' THEN 0 WHEN task = 'PROMO' THEN 1 ELSE 2 END AS a, CASE WHEN author = 'Brand#0' THEN 0 WHEN author IN ('Brand#1', 'Brand#2') THEN 1 ELSE 2 END AS b,
        CASE WHEN p_size < 3 THEN 0 WHEN p_size < 12 THEN 1 ELSE 2 END AS c, CASE WHEN likes > 1000000 THEN 0 WHEN likes > 33 THEN 1 ELSE 2 END AS d, CASE WHEN list_contains(features, 'ring') THEN 0 ELSE 1 END AS e FROM catalogue),
    h AS MATERIALIZED (SELECT a, b, c, d, count(*) AS n FROM l WHERE e = 0 GROUP BY ALL), one AS MATERIALIZED (SELECT 'a' AS g, a AS v, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'b', b, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'c', c, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'd', d, count(*) FROM l GROUP BY 2),
    s AS (SELECT 0 AS step, NULL::VARCHAR AS name, 0 AS a, 0 AS b, 0 AS c, 0 AS d, coalesce((SELECT sum(n) FROM h WHERE a = 0 AND b = 0 AND c = 0 AND d = 0), 0)::BIGINT AS hits
      UNION ALL SELECT step + 1, name, a, b, c, d, coalesce((SELECT sum(n) FROM h WHERE h.a <= z.a AND h.b <= z.b AND h.c <= z.c AND h.d <= z.d), 0)::BIGINT FROM (
        SELECT step, CASE pick WHEN 1 THEN 'task' WHEN 2 THEN 'brand' WHEN 3 THEN 'size' ELSE 'likes' END AS name, a + (pick = 1)::INT AS a, b + (pick = 2)::INT AS b, c + (pick = 3)::INT AS c, d + (pick = 4)::INT AS d FROM (
          SELECT step, a, b, c, d, CASE least(ka, kb, kc, kd) WHEN ka THEN 1 WHEN kb THEN 2 WHEN kc THEN 3 ELSE 4 END AS pick, least(ka, kb, kc, kd) AS k FROM (
            SELECT step, a, b, c, d, CASE WHEN a < 1 THEN (coalesce((SELECT sum(n) FROM one WHERE g = 'a' AND v <= s.a), 0) > 0)::INT * 10000 + 1000 + 400 + a * 10 + 1 ELSE 99999 END AS ka,
              CASE WHEN b < 2 THEN (coalesce((SELECT sum(n) FROM one WHERE g = 'b' AND v <= s.b), 0) > 0)::INT * 10000 + 300 + b * 10 + 2 ELSE 99999 END AS kb, CASE WHEN c < 2 THEN (coalesce((SELECT sum(n) FROM one WHERE g = 'c' AND v <= s.c), 0) > 0)::INT * 10000 + 1000 + 200 + c * 10 + 3 ELSE 99999 END AS kc,
              CASE WHEN d < 2 THEN (coalesce((SELECT sum(n) FROM one WHERE g = 'd' AND v <= s.d), 0) > 0)::INT * 10000 + 1000 + 100 + d * 10 + 4 ELSE 99999 END AS kd FROM s WHERE hits < {TARGET})) WHERE k < 99999) AS z),
    u AS MATERIALIZED (SELECT coalesce(min(step) FILTER (hits >= {TARGET}), arg_max(step, (hits, -step))) AS until FROM s)"""


def guided(spark, d):
    docs, groups = catalogue(spark, d), wishes()
    return docs, groups, relaxation.guided(relaxation.counts(docs, None, groups), groups, TARGET)


@query(GUIDED + " SELECT step::INT AS step, name, a AS task, b AS brand, c AS size, d AS likes, hits, step = until AS chosen FROM s, u")
def relaxation_steps(spark, d):
    """Filters given up one level at a time, first where nothing passes them at all, until 40 records hold."""
    _, _, choice = guided(spark, d)
    rows = [(k, name, *at[:4], hits, at == choice.levels) for k, (name, at, hits) in enumerate(choice.steps)]
    return spark.createDataFrame(rows, "step int, name string, task int, brand int, size int, likes int, hits bigint, chosen boolean")


@query(GUIDED + " SELECT model_id, l.likes, min(step)::INT AS tier FROM l JOIN s ON l.a <= s.a AND l.b <= s.b AND l.c <= s.c AND l.d <= s.d AND l.e = 0, u WHERE step <= until GROUP BY ALL")
def rank_relaxed_guided(spark, d):
    """The records of the chosen step, and the step at which each came in."""
    docs, groups, choice = guided(spark, d)
    return relaxation.rows(docs, None, groups, choice).select("model_id", "likes", "tier")


@query(GUIDED + f""", k AS (SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d, e.x AS e FROM range(2) a(x), range(3) b(x), range(3) c(x), range(3) d(x), range(2) e(x)),
    n AS MATERIALIZED (SELECT k.*, (SELECT count(*) FROM l WHERE l.a <= k.a AND l.b <= k.b AND l.c <= k.c AND l.d <= k.d AND l.e <= k.e) AS hits, round(k.a * 16.0 + k.b * 2.6 + k.c * 1.6 + k.d * 0.8 + k.e * 3.0, 9) AS cost FROM k)
    SELECT a::INT AS task, b::INT AS brand, c::INT AS size, d::INT AS likes, e::INT AS ring, hits FROM n WHERE hits >= least({TARGET}, (SELECT max(hits) FROM n)) ORDER BY cost, hits DESC, a, b, c, d, e LIMIT 1""")
def relaxation_cheapest(spark, d):
    """The cheapest levels with 40 records, of all combinations."""
    docs, groups = catalogue(spark, d), wishes()
    choice = relaxation.cheapest(relaxation.counts(docs, None, groups), groups, TARGET)
    return spark.createDataFrame([(*choice.levels, choice.hits)], "task int, brand int, size int, likes int, ring int, hits bigint")


# ---- trios

@query(f"""WITH {CATALOGUE}, n AS MATERIALIZED (SELECT model_id AS id, task AS grp, author AS maker, likes, list_distinct(features) AS f FROM catalogue),
    e AS MATERIALIZED (SELECT a.grp, a.id AS a, b.id AS b FROM n a JOIN n b ON a.grp = b.grp AND a.id <> b.id AND a.maker <> b.maker WHERE len(list_intersect(a.f, b.f)) / least(len(a.f), len(b.f)) > 0.5),
    t AS (SELECT x.grp, m.likes + p.likes + q.likes AS score, list_sort([m.id, p.id, q.id]) AS ids FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN n m ON m.id = x.a JOIN n p ON p.id = x.b JOIN n q ON q.id = y.b WHERE p.maker <> q.maker)
    SELECT grp, score, ids[1] AS first, ids[2] AS second, ids[3] AS third FROM (SELECT grp, score, ids, row_number() OVER (PARTITION BY grp ORDER BY score DESC, ids) AS k FROM t) WHERE k = 1""")
def best_trios(spark, d):
    """Of each task the three most liked records of different makers of which two pairs share more than half of their features."""
    t = trios.best_trios(catalogue(spark, d).select(F.col("model_id").alias("id"), F.col("task").alias("grp"), F.col("author").alias("maker"), "likes", "features"), 0.5)
    return t.select("grp", "score", F.col("ids")[0].alias("first"), F.col("ids")[1].alias("second"), F.col("ids")[2].alias("third"))


# ---- open JSON

@query("""SELECT event_id, j.key AS path, CASE j.type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE j.type END AS kind, CASE j.type WHEN 'VARCHAR' THEN j.value ->> '$' ELSE j.value::VARCHAR END AS value FROM events, json_each(props) j""")
def json_paths(spark, d):
    """Every path of the events' properties."""
    return J.leaves(table(spark, d, "events"), "event_id", "props")


NESTED = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_extract_all(lower(x), '[a-z]+'))"


@query(f"""WITH t AS (SELECT conv_id::VARCHAR || ':' || turn AS id, conv_id, turn, role, {NESTED} AS lines FROM conversations), l AS (SELECT id, unnest(lines) AS w, unnest(range(len(lines))) AS k FROM t)
    SELECT id, 'conv_id' AS path, 'BIGINT' AS kind, conv_id::VARCHAR AS value FROM t UNION ALL SELECT id, 'turn.n', 'BIGINT', turn::VARCHAR FROM t UNION ALL SELECT id, 'turn.role', 'STRING', role FROM t UNION ALL SELECT id, 'turn.none', 'VOID', NULL FROM t
    UNION ALL SELECT id, 'tags', 'ARRAY', to_json([role, 'x'])::VARCHAR FROM t UNION ALL SELECT id, 'lines[' || k || '].no', 'BIGINT', k::VARCHAR FROM l UNION ALL SELECT id, 'lines[' || k || '].words', 'ARRAY', to_json(w)::VARCHAR FROM l
    UNION ALL SELECT id, 'mixed[0]', 'BIGINT', turn::VARCHAR FROM t UNION ALL SELECT id, 'mixed[1].a', 'STRING', role FROM t UNION ALL SELECT id, 'mixed[2]', 'ARRAY', '[]' FROM t""")
def json_paths_nested(spark, d):
    """Every path of a document made of a turn: objects in lists in objects, lists of scalars, lists of both, nulls."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, k: F.struct(k.cast("long").alias("no"), F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)).alias("words")))
    nested = F.to_json(F.struct("conv_id", F.struct(F.col("turn").alias("n"), "role", F.lit(None).cast("string").alias("none")).alias("turn"), lines.alias("lines"), F.array("role", F.lit("x")).alias("tags")), {"ignoreNullFields": "false"})
    mixed = F.format_string(',"mixed":[%d,{"a":"%s"},[],{}]}', "turn", "role")  # a struct's list has items of one type
    docs = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.substring(nested, F.lit(1), F.length(nested) - 1), mixed).alias("doc"))
    return J.leaves(docs, "id", "doc")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN role || '|x' END AS metrics, CASE WHEN turn % 4 = 0 THEN turn ELSE -1 END AS deep, CASE WHEN turn % 4 = 1 THEN 5 ELSE -1 END::BIGINT AS zero, CASE turn % 4 WHEN 0 THEN '{"metrics":["' || role || '","x"],"z":' || turn || '}' WHEN 1 THEN '{"metrics":"' || role || '"}' END AS only,
    CASE turn % 4 WHEN 0 THEN '{"z":' || turn || ',"metrics":["' || role || '","x"]}' WHEN 1 THEN '{"z":null,"metrics":"' || role || '"}' END AS fixed FROM conversations""")
def json_guards(spark, d):
    """Paths, type guards and chosen keys of documents that differ: an object, another one, a list, text that is no JSON."""
    r = F.col("turn") % 4
    text = F.when(r == 0, F.format_string('{"metrics":["%s","x"],"a":{"b":[{"c":%d}]},"z":%d}', "role", "turn", "turn")).when(r == 1, F.format_string('{"a":{"0":5},"metrics":"%s"}', "role")).when(r == 2, F.format_string('[%d,{"z":1}]', "turn")).otherwise("{oops")
    v = table(spark, d, "conversations").select("conv_id", "turn", J.parsed(text).alias("v"))
    return v.select("conv_id", "turn", F.array_join(J.only_strings(J.at("v", "metrics")), "|").alias("metrics"), F.coalesce(J.at("v", "a.b.0.c", "bigint"), F.lit(-1)).alias("deep"), F.coalesce(J.at("v", "a.0", "bigint"), F.lit(-1)).alias("zero"), F.to_json(J.only_keys(F.col("v"), ["metrics", "z"])).alias("only"), J.with_keys(F.col("v"), ["z", "metrics"]).alias("fixed"))


@query("""SELECT j.key AS key, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE j.type WHEN 'UBIGINT' THEN 'BIGINT' ELSE j.type END))), ',') AS kinds FROM events, json_each(props) j GROUP BY 1""")
def json_keys(spark, d):
    """The keys of the events' properties: how many have each, and of which types."""
    return J.key_counts(table(spark, d, "events"), "props").select("key", "n", F.array_join("kinds", ",").alias("kinds"))
