"""Queries of technical texts: pages' scripts stand for code, titles, headings and links for phrases, conversations for READMEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import technical

from .catalogue import table
from .registry import query

SCRIPT = r"(?s)<script[^>]*>.*?</script>"
PHRASE = r"<(?:title|h1|h2|a)(?: [^>]*)?>([^<]*)</(?:title|h1|h2|a)>"
HINTS, STOP, DENY = ("api", "token", "sql", "query", "index"), ("the", "and", "la", "le", "der", "die", "que", "de"), ("the the",)

IDENTIFIERS = r"""WITH s AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>'), lambda b: regexp_replace(b, '^<script[^>]*>|</script>$', '', 'g')), ' ') AS s FROM pages),
    i AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(s, '[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)*'), lambda n: length(n) >= 3)) AS names FROM s)"""


def _identified(spark, d):
    return table(spark, d, "pages").select("page_id", "html", technical.identifiers(F.col("html"), SCRIPT, "^<script[^>]*>|</script>$").alias("names"))


@query(IDENTIFIERS + " SELECT page_id, len(names)::BIGINT AS n_names, array_to_string(list_sort(names), ' ') AS names FROM i")
def page_identifiers(spark, d):
    """Names within the scripts of whole pages."""
    return _identified(spark, d).select("page_id", F.size("names").cast("long").alias("n_names"), F.array_join(F.sort_array("names"), " ").alias("names"))


@query(IDENTIFIERS + r""", p AS (SELECT page_id, names, unnest(l) AS raw, unnest(range(len(l))) AS place FROM (SELECT page_id, names, regexp_extract_all(html, '<(?:title|h1|h2|a)(?: [^>]*)?>([^<]*)</(?:title|h1|h2|a)>', 1) AS l FROM pages JOIN i USING (page_id))),
    b AS (SELECT page_id, names, place, regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^[ \t\r\n"''“”‘’.,;:()\[\]{}]+|[ \t\r\n"''“”‘’.,;:()\[\]{}]+$', '', 'g') AS phrase FROM p),
    k AS (SELECT * FROM b WHERE length(phrase) BETWEEN 3 AND 80 AND lower(phrase) <> 'the the' AND len(list_filter(string_split(lower(phrase), ' '), lambda w: w IN ('the', 'and', 'la', 'le', 'der', 'die', 'que', 'de'))) <= .6 * len(string_split(phrase, ' '))),
    z AS (SELECT page_id, phrase, place, 2 * regexp_matches(phrase, '[A-Za-z][\p{L}\p{N}_]*_[A-Za-z0-9_]|(?:^|[^\p{L}\p{N}_])(?:[a-z]+[A-Z]|[A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_]|[0-9]))')::INT + 2 * regexp_matches(phrase, '(?:^|[^\p{L}\p{N}_])[A-Z]{2,}(?:$|[^\p{L}\p{N}_])')::INT + 2 * regexp_matches(phrase, '[0-9%/-]')::INT
        + CASE WHEN list_contains(names, phrase) THEN 3 WHEN len(list_filter(names, lambda n: contains(phrase, n))) > 0 THEN 2 ELSE 0 END + least(len(list_filter(['api', 'token', 'sql', 'query', 'index'], lambda h: contains(lower(phrase), h))), 1) AS score FROM k)
    SELECT page_id, arg_min(phrase, place) AS phrase, arg_min(score, place)::BIGINT AS score FROM z WHERE score >= 2 GROUP BY page_id, lower(phrase)""")
def technical_phrases(spark, d):
    """Titles, headings and link labels that look technical, each once a page as first seen (by letters of either case)."""
    p = _identified(spark, d).select("page_id", "names", F.posexplode(F.regexp_extract_all("html", F.lit(PHRASE), F.lit(1))).alias("place", "raw")).withColumn("phrase", technical.bare(F.col("raw")))
    score = technical.technical_score(F.col("phrase"), F.col("names"), HINTS).cast("long")
    s = p.filter(technical.worth_scoring(F.col("phrase"), STOP, DENY)).select("page_id", "phrase", "place", score.alias("score")).filter("score >= 2")
    first = s.groupBy("page_id", F.lower("phrase").alias("low")).agg(F.min(F.struct("place", "phrase", "score")).alias("x"))
    return first.select("page_id", "x.phrase", "x.score")


@query(r"""WITH r AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '## ' ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn) AS r FROM conversations GROUP BY 1),
    m AS (SELECT conv_id, '---' || chr(10) || 'id: ' || conv_id || chr(10) || '---' || chr(10) || '# Talk ' || conv_id || chr(10) || '| a | b |' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '# Access' || chr(10) || 'You need to <b>agree</b> first' || chr(10) || r AS t, 'talk ' || conv_id AS title FROM r),
    c AS (SELECT conv_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?ms)^---\s*\n.*?\n---\s*\n', '', 'g'), '(?m)^(#{1,6}\s)', chr(10) || chr(10) || '\1', 'g'), '(?ms)^```.*?```', '', 'g'), '(?m)^\|.*\|$', '', 'g'), '(?s)<[^>]+>', '', 'g') AS t FROM m),
    p AS (SELECT conv_id, title, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM c),
    q AS (SELECT conv_id, CASE WHEN lower(p[1]).ends_with(title) THEN p[2:] ELSE p END AS p FROM p)
    SELECT conv_id, len(p)::BIGINT AS n_paragraphs, md5(array_to_string(list_filter(p, lambda x: NOT regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(agree|login|sign[\s-]?up|access this model|conditions?|use this model|you need to)($|[^\p{L}\p{N}_])')), chr(10) || chr(10))) AS description_md5 FROM q""")
def readme_descriptions(spark, d):
    """READMEs made of conversations, with front matter, a table, code and a notice; descriptions are their prose."""
    turn = F.concat(F.when(F.col("role") == "user", "## ").otherwise(""), F.coalesce("text", F.lit("")))
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("r"))
    head = F.concat(F.lit("---\nid: "), "conv_id", F.lit("\n---\n# Talk "), "conv_id", F.lit("\n| a | b |\n```\ncode\n```\n# Access\nYou need to <b>agree</b> first\n"), "r")
    text = technical.readme_description(head, F.concat(F.lit("talk "), F.col("conv_id")))
    notices = F.size(technical.paragraphs(text)).cast("long") + 1  # the notice went
    return r.select("conv_id", notices.alias("n_paragraphs"), F.md5(text).alias("description_md5"))
