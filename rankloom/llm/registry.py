"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontaminate, language_id, phrase_dedup, pii, quality_rules, simhash, suffix_dedup, token_alignment, token_files, url_filter, warc
from .common import table, written


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose id is the page's: bad if of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, languages = language_id.train(language_id.training_rows(docs, ~held_out()))
    return language_id.identify(docs, model, languages).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.concat(*pii.BASE)
    every = F.concat(*pii.BASE, "term", "removed_term")
    return found.select(F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(every).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality_rules.text_statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judged(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.filed(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_decontaminate, op3_language_id, op4_byte_bpe, op5_pii, op6_warc, op7_quality_rules, op8_suffix_dedup, op9_simhash, op10_phrase_dedup, op11_token_alignment, op12_token_files, op13_centroids)}

#: After the words u of every document: the windows of 50 that a smaller document has too, and what they leave.
REPEATED = """
        , g AS (SELECT doc_id, u, list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i + 49 <= len(u) THEN md5({window}) END) AS ws FROM t),
        h AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x, unnest(ws) AS w FROM g),
        f AS (SELECT doc_id, i, x, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS starts FROM h),
        k AS (SELECT doc_id, i, x, max(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
        r AS (SELECT *, CASE WHEN gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) = 0 THEN 1 ELSE 0 END AS opens FROM k)"""

#: A round of operator 13 in SQL: each vector's nearest centroid, and the floors of the means.
ROUND = """
        a{r} AS MATERIALIZED (SELECT id, v, min({{'d': d, 'j': j}}) AS m FROM (SELECT k.id, k.v, c.j, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{r} AS c) GROUP BY id, v),
        c{s} AS MATERIALIZED (SELECT j, list(coalesce(x, c) ORDER BY i) AS c FROM (SELECT j, unnest(c) AS c, unnest(range(1, 65)) AS i FROM c{r})
               LEFT JOIN (SELECT m.j AS j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT m, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2) USING (j, i) GROUP BY j)"""

ORACLE_SQL = {
    "op13_centroids": """
        WITH k AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || id)) - 1 AS j, v AS c FROM k ORDER BY sha256('3:' || id) LIMIT 8),"""
    + ",".join(ROUND.format(r=r, s=r + 1) for r in range(11))
    + """
        SELECT id AS vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.c, ',')) AS centroid_sha256 FROM a10 JOIN c10 ON m.j = c10.j""",
    "op1_url_filters": """
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
        j AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
                     string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM p),
        o AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS k FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
        h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CASE WHEN host = '' THEN 0 ELSE coalesce(sum(n), 0) END AS n, CASE WHEN host = '' THEN 0 ELSE coalesce(sum(k), 0) END AS k FROM j LEFT JOIN o USING (page_id) GROUP BY host),
        s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1e0) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix), s1 AS (SELECT suffix, (s * m + k) / (s + n) AS rate FROM s0, (SELECT STRENGTH FROM s0)),
        d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(rate) AS m FROM h JOIN s1 USING (suffix) GROUP BY domain), d1 AS (SELECT domain, (s * m + k) / (s + n) AS rate FROM d0, (SELECT STRENGTH FROM d0)),
        h0 AS (SELECT host, n, k, rate AS m FROM h JOIN d1 USING (domain)), h1 AS (SELECT host, s * m + k AS a, s * (1 - m) + n - k AS b FROM h0, (SELECT STRENGTH FROM h0))
        SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
               ELSE CASE WHEN a / (a + b) - 1.645e0 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END END AS verdict FROM j JOIN h1 USING (host)""".replace(
        "STRENGTH",
        """coalesce(least(greatest(CASE WHEN r > 0 THEN (1 - r) / r END, 1e0), 1e3), 1e3) AS s FROM (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END AS r""",
    ).replace("AS r FROM s0)", "AS r FROM s0 WHERE n > 1))").replace("AS r FROM d0)", "AS r FROM d0 WHERE n > 1))").replace("AS r FROM h0)", "AS r FROM h0 WHERE n > 1))"),
    "op10_phrase_dedup": """
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS u FROM documents)"""
    + REPEATED.format(window="array_to_string(u[i:i + 49], ' ')")
    + """, z AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN z USING (doc_id)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q""",
}
