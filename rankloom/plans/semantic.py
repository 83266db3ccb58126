"""Queries over vectors: neighbours, synonyms, and a ranking that fuses them with the lexical ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import neighbours, ranking

from .catalogue import CATALOGUE, CRITERIA, SIGNALS, catalogue, table
from .registry import query


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def built(spark, d):
    v = vectors(spark, d)
    return neighbours.index(v, neighbours.train(v, "vec_id", "embedding"), "vec_id", "embedding", ("label",))


def asked(spark, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(spark, d).filter("vec_id % 100 = 0")


PAIRS = """q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score, label FROM q, embeddings WHERE vec_id <> query_id)"""


@query(f"WITH {PAIRS} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def neighbours_exact(spark, d):
    """The ten nearest of each query, from the cells that can hold them."""
    return neighbours.search(built(spark, d), asked(spark, d), "vec_id", "embedding", 10)


@query(f"WITH {PAIRS} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label % 2 = 1) WHERE rank <= 10")
def neighbours_filtered(spark, d):
    """The ten nearest among the vectors with an odd label: filtered before the search."""
    return neighbours.search(built(spark, d).where(F.col("label") % 2 == 1), asked(spark, d), "vec_id", "embedding", 10)


@query(f"WITH {PAIRS} SELECT query_id, id AS synonym, greatest(0, least(1, score)) AS confidence FROM s WHERE score >= 0.35")
def synonyms(spark, d):
    """Everything at least 0.35 similar to a query, its similarity as confidence."""
    return neighbours.within(built(spark, d), asked(spark, d), "vec_id", "embedding", 0.35).select("query_id", F.col("id").alias("synonym"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("confidence"))


@query(f"""WITH {CATALOGUE}, s AS (SELECT model_id, CASE WHEN task = 'ECONOMY' THEN 3.2e0 WHEN task = 'PROMO' THEN 3.2e0 * 0.85e0 ELSE 0e0 END AS a, CASE WHEN list_contains(features, 'small') THEN 1.3e0 WHEN list_contains(features, 'tiny') THEN 1.3e0 * 0.8e0 ELSE 0e0 END AS b, CASE WHEN list_contains(features, 'ring') THEN 1.5e0 WHEN list_contains(features, 'widget') THEN 1.5e0 * 0.64e0 ELSE 0e0 END AS c, least(0.5e0 * log10(1 + likes) + 0.25e0 * log10(1 + downloads), 1.5e0) AS g FROM catalogue),
    o AS (SELECT model_id, round(list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]), 6) AS x FROM catalogue JOIN embeddings e ON vec_id = model_id, (SELECT embedding FROM embeddings WHERE vec_id = 100) x WHERE task IN ('ECONOMY', 'PROMO') AND vec_id <> 100),
    r AS (SELECT model_id, a + b + c + g AS x, 5e0 AS w, 1 AS k FROM s WHERE a + b + c > 0 UNION ALL SELECT model_id, a + g, 4e0, 2 FROM s WHERE a > 0 UNION ALL SELECT model_id, b + c + g, 1.5e0, 3 FROM s WHERE b + c > 0 UNION ALL SELECT model_id, c + g, .75e0, 4 FROM s WHERE c > 0 UNION ALL SELECT model_id, x, 2.5e0, 5 FROM o),
    t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, model_id) AS n FROM r)
    SELECT model_id, round(sum(w / (60 + n)), 8) AS score FROM t WHERE n <= 100 GROUP BY model_id ORDER BY score DESC, model_id LIMIT 20""")
def rank_hybrid_semantic(spark, d):
    """Four lexical strategies and the hundred nearest of a stated vector among records of the wanted tasks, fused by reciprocal ranks."""
    docs, (economy, small, ring, _) = catalogue(spark, d), CRITERIA
    parts = []
    for criteria, weight in (([economy, small, ring], 5.0), ([economy], 4.0), ([small, ring], 1.5), ([ring], 0.75)):
        top = ranking.rank(docs, criteria, SIGNALS, minimum=1, k=100)
        parts.append((top.select("model_id", F.row_number().over(Window.orderBy(F.desc("score"), "model_id")).alias("rank")), weight))  # over 100 rows
    v = vectors(spark, d).join(docs.select(F.col("model_id").alias("vec_id"), "task"), "vec_id")
    of = neighbours.index(v, neighbours.train(v, "vec_id", "embedding"), "vec_id", "embedding", ("task",)).where(F.col("task").isin("ECONOMY", "PROMO"))
    near = neighbours.search(of, vectors(spark, d).filter("vec_id = 100"), "vec_id", "embedding", 100)
    parts.append((near.select(F.col("id").alias("model_id"), "rank"), 2.5))
    return ranking.fuse(parts).select("model_id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "model_id").limit(20)
