"""Families and modalities from tables of hints, patterns and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import families

from .catalogue import table
from .registry import query

HINTS = [("economy", "thrift", "thrift-e", 0.93), ("Economy", "saver", None, 0.90), ("MEDIUM", "middle", None, 0.93)]
PATTERNS = [("red ring", "ring", "ring-red", 0.97), ("ring", "ring", None, 0.95), ("small", "tiny", None, 0.9)]
ALIASES = [("name", "bolt", "bolt", 0.5), ("tag", "promo", "bolt", 0.2), ("name", "hot", "bolt", 0.1), ("tag", "promo", "promo", 0.3), ("kind", "promo", "promo", 0.1), ("name", "gear", "gear", 0.27), ("tag", "brand", "gear", 0.005), ("kind", "large", "gear", 0.05)]
ROUTES = [("ring", "image"), ("economy", "text"), ("gear", "audio"), ("widget", "image"), ("promo", "text")]


def values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}e0" for x in r) + ")" for r in rows)


@query(f"""WITH h AS (SELECT lower(k) AS k, min((-c, f, coalesce(ch, ''))) AS h FROM (VALUES {values(HINTS)}) t(k, f, ch, c) GROUP BY 1), m AS (SELECT p_partkey, lower(p_type) AS kind, ' ' || lower(p_name) || ' ' AS t, string_split(lower(p_name), ' ') AS n, list_distinct(string_split(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' ')) AS g FROM part),
    p AS (SELECT p_partkey, arg_max((f, ch, c), length(ph)) AS p FROM m JOIN (VALUES {values(PATTERNS)}) t(ph, f, ch, c) ON contains(m.t, ' ' || ph || ' ') GROUP BY 1),
    s AS (SELECT p_partkey, f, round(sum(w), 9) AS w FROM m JOIN (VALUES {values(ALIASES)}) t(fi, wo, f, w) ON (fi = 'name' AND list_contains(n, wo)) OR (fi = 'tag' AND list_contains(g, wo)) OR (fi = 'kind' AND kind = wo) GROUP BY ALL),
    a AS (SELECT p_partkey, arg_max(f, (w, f)) AS f, max(w) AS w, coalesce(list_sort(list(w), 'DESC')[2], 0) AS second FROM s GROUP BY 1)
    SELECT m.p_partkey, CASE WHEN h IS NOT NULL THEN struct_extract_at(h, 2) WHEN p IS NOT NULL THEN struct_extract_at(p, 1) WHEN w >= .28 AND round(w - second, 9) >= .08 THEN a.f ELSE 'Other / Unclear' END AS family, CASE WHEN h IS NOT NULL THEN nullif(struct_extract_at(h, 3), '') WHEN p IS NOT NULL THEN struct_extract_at(p, 2) END AS child,
      CASE WHEN h IS NOT NULL THEN -struct_extract_at(h, 1) WHEN p IS NOT NULL THEN struct_extract_at(p, 3) WHEN w >= .28 AND round(w - second, 9) >= .08 THEN .8 ELSE 0 END::DOUBLE AS confidence, CASE WHEN h IS NOT NULL THEN 'hint' WHEN p IS NOT NULL THEN 'pattern' WHEN w >= .28 AND round(w - second, 9) >= .08 THEN 'alias' ELSE 'none' END AS rule
    FROM m LEFT JOIN h ON h.k = m.kind LEFT JOIN p USING (p_partkey) LEFT JOIN a USING (p_partkey)""")
def family_by_tables(spark, d):
    """The family of each record from a table of hints, one of patterns and one of weighted aliases."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("tags"))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = families.by_tables(part, make(HINTS, "kind string, family string, child string, confidence double"), make(PATTERNS, "phrase string, family string, child string, confidence double"), make(ALIASES, "field string, word string, family string, weight double"))
    return got.withColumnRenamed("id", "p_partkey")


@query(f"""WITH m AS (SELECT p_partkey, list_sort(list_distinct(list(r))) AS r FROM part, (VALUES {values(ROUTES)}) t(w, r) WHERE list_contains(string_split(lower(p_type || ' ' || p_name), ' '), w) GROUP BY 1)
    SELECT p_partkey, CASE WHEN len(r) > 1 THEN 'multimodal' WHEN len(r) = 1 THEN r[1] ELSE 'other' END AS route, coalesce(array_to_string(r, ','), '') AS routes FROM part LEFT JOIN m USING (p_partkey)""")
def modality_by_table(spark, d):
    """Where each record's words route it, from a table of words."""
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    got = families.routed(texts, spark.createDataFrame(ROUTES, "word string, route string"))
    return got.select(F.col("id").alias("p_partkey"), "route", F.array_join("routes", ",").alias("routes"))
