"""Queries of phrases without a tagger, and of hierarchies in Turtle files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.operators import keyphrases
from rankloom.operators.rounds import kept, shared_folder
from rankloom.sources import turtle

from .catalogue import table
from .registry import query

#: Words that end a phrase, of the languages of the texts.
STOP = ("the", "a", "an", "of", "and", "or", "in", "on", "to", "for", "with", "that", "this", "is", "are", "was", "it", "as", "by", "at", "from", "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "der", "die", "das", "und", "ein", "eine", "nicht", "mit", "von", "el", "los", "las", "y", "es", "por", "con")
RUNS = "r AS MATERIALIZED (SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+(?:''\\p{L}+)*|[^\\p{L}\\s]'), lambda w: CASE WHEN w IN (" + ", ".join(f"'{w}'" for w in STOP) + ") OR NOT regexp_matches(w, '^\\p{L}') THEN '|' ELSE w END), ' '), '|'), lambda x: trim(x)), lambda x: x <> '')) AS phrase FROM documents)"
WORDS = """c AS MATERIALIZED (SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs, string_split(phrase, ' ') AS w FROM r GROUP BY phrase), e AS MATERIALIZED (SELECT phrase, n, len(w) AS size, unnest(range(len(w))) AS i, unnest(w) AS word FROM c),
    s AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS freq, sum(n * size)::BIGINT AS degree, sum(CASE WHEN i = size - 1 THEN n ELSE 0 END)::BIGINT AS ends FROM e GROUP BY word)"""


def runs(spark, d):
    return kept(keyphrases.candidates(table(spark, d, "documents"), "doc_id", "text", STOP), "runs")


@query(f"WITH {RUNS}, {WORDS} SELECT e.phrase, n, n_docs, round(sum(degree / freq), 6) AS score FROM e JOIN s USING (word) JOIN (SELECT phrase, n_docs FROM c) USING (phrase) GROUP BY e.phrase, n, n_docs")
def phrase_candidates(spark, d):
    """Runs of words between stop words and marks, scored by their words' degrees."""
    return keyphrases.scored(runs(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {RUNS}, {WORDS} SELECT phrase, h[3] AS head, array_to_string(string_split(phrase, ' ')[1:h[2]::INT], ' ') AS modifiers FROM (SELECT phrase, max([lpad((ends / freq * 1e15)::BIGINT::VARCHAR, 20, '0'), lpad(i::VARCHAR, 6, '0'), word]) AS h FROM e JOIN s USING (word) GROUP BY phrase)")
def phrase_heads(spark, d):
    """The head of each phrase: the word that most often ends runs, and what modifies it."""
    return keyphrases.heads(runs(spark, d))


@query(f"WITH {RUNS}, p AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w FROM r), t AS (SELECT phrase, w, unnest(range(1, len(w))) AS k FROM p), m AS (SELECT t.phrase, t.w, min(k) AS k FROM t JOIN p ON p.phrase = array_to_string(t.w[k + 1:], ' ') GROUP BY ALL) SELECT phrase, array_to_string(w[k + 1:], ' ') AS parent, array_to_string(w[1:k], ' ') AS modifier FROM m")
def phrase_parents(spark, d):
    """Of each phrase the longest one that is left without words in front and stands alone elsewhere."""
    return keyphrases.parents(runs(spark, d))


@query("""WITH e AS (SELECT s_suppkey, s_nationkey AS nation FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 2 = 0),
    p AS (SELECT r_name || ' > ' || n_name AS path, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT p.path || ' > ' || s_name AS path FROM e JOIN supplier USING (s_suppkey) JOIN p ON p.n_nationkey = e.nation UNION ALL SELECT path FROM p WHERE n_nationkey NOT IN (SELECT nation FROM e) UNION ALL SELECT r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""")
def turtle_paths(spark, d):
    """Regions, nations and suppliers written as Turtle (suppliers of even key have two parents, and a step back to themselves) and read
    back: the paths from roots to leaves."""
    lit = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    c = lambda name: F.col(name).cast("string")
    head = spark.createDataFrame([("@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix x: <http://example.org/x/> .",)], "value string")
    regions = table(spark, d, "region").select(lit("x:r", c("r_regionkey"), " a skos:Concept ;\n  skos:prefLabel \"", c("r_name"), "\"@en, \"R ", c("r_regionkey"), "\"@de .").alias("value"))
    nations = table(spark, d, "nation").select(lit("<http://example.org/x/n", c("n_nationkey"), "> skos:broader x:r", c("n_regionkey"), " ; skos:altLabel \"", c("n_name"), "\" .").alias("value"))
    other = ((F.col("s_nationkey") + 1) % 25).cast("string")
    second = F.when(F.col("s_suppkey") % 2 == 0, lit(" , x:n", other, " , x:s", c("s_suppkey"))).otherwise("")
    suppliers = table(spark, d, "supplier").select(lit("x:s", c("s_suppkey"), " a skos:Concept ; # a supplier\n  skos:prefLabel \"", c("s_name"), "\" ;\n  skos:broader x:n", c("s_nationkey"), second, " .").alias("value"))
    path = f"{shared_folder(spark)}/rankloom/turtle-{uuid.uuid4().hex}"
    head.unionByName(regions).unionByName(nations).unionByName(suppliers).write.text(path)
    return turtle.paths(kept(turtle.triples(spark, path), "triples")).select(F.array_join("path", " > ").alias("path"))
