"""Turtle files: statements, triples, labels, and the paths of a hierarchy.

A file is read in splits: a statement ends with a dot at the end of a line. Terms are prefixed names, <addresses>, blank nodes,
literals with a language or a type, numbers and booleans; one subject may have many predicates (;) and objects (,). Statements
with blank node property lists [...] or collections (...) aren't taken apart: ``unread`` gives them. A literal with a line that
ends in a dot isn't supported.

Tokens become rows, so a subject with very many objects is no large value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.rounds import kept

SKOS, RDF, RDFS = "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
LITERAL = r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"'
TOKEN = rf'<[^<>"\s]*>|(?:{LITERAL})(?:@[A-Za-z][A-Za-z0-9-]*|\^\^(?:<[^<>\s]*>|[\w-]*:[\w.-]*))?|_:[\w-]+|[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|#[^\n]*|[;,\[\]()]|[^\s;,\[\]()]+'
#: Which label counts, best first.
LABELS = (f"{SKOS}prefLabel", f"{SKOS}altLabel", f"{RDFS}label")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each statement, without its dot."""
    return spark.read.text(path, lineSep=".\n").select(F.regexp_replace("value", r"\s*\.?\s*$", "").alias("text")).filter(F.trim("text") != "")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(prefix, base): a row for each declaration."""
    said = F.regexp_extract_all("text", F.lit(r"(?i)@?prefix\s+([\w-]*:)\s*<([^<>\s]*)>"), F.lit(1))
    base = F.regexp_extract_all("text", F.lit(r"(?i)@?prefix\s+([\w-]*:)\s*<([^<>\s]*)>"), F.lit(2))
    return rows.filter(F.col("text").rlike(r"(?i)@?prefix\s")).select(F.explode(F.arrays_zip(said.alias("prefix"), base.alias("base"))).alias("x")).select("x.prefix", "x.base").dropDuplicates(["prefix"])


def _tokens() -> F.Column:
    """Of a statement without its declarations and comments."""
    plain = F.regexp_replace("text", r"(?im)^\s*@?(?:prefix\s+[\w-]*:|base)\s*<[^<>\s]*>\s*\.?\s*", "")
    return F.filter(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the statements that triples leaves out."""
    return statements(spark, path).filter(F.exists(_tokens(), lambda t: t.isin("[", "]", "(", ")")))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, lang): addresses in full, blank nodes as they are, literals as their text; lang is a literal's language, '' for
    none, null for what is no literal."""
    rows = statements(spark, path)
    t = rows.select(F.monotonically_increasing_id().alias("k"), _tokens().alias("t")).filter((F.size("t") > 2) & ~F.exists("t", lambda t: t.isin("[", "]", "(", ")")))
    each = kept(t.select("k", F.posexplode("t").alias("i", "t")), "tokens")
    w = Window.partitionBy("k").orderBy("i")
    parts = each.withColumn("part", F.sum((F.col("t") == ";").cast("int")).over(w))
    first = Window.partitionBy("k", "part").orderBy("i")
    own = parts.filter("t not in (';', ',')").withColumn("n", F.row_number().over(first))
    # the statement's first token is the subject, each part's first one (the second of part 0) its predicate
    shifted = own.withColumn("n", F.col("n") - (F.col("part") == 0).cast("int"))
    role = lambda n: shifted.filter(n)
    subject = role((F.col("part") == 0) & (F.col("n") == 0)).select("k", F.col("t").alias("s"))
    predicate = role(F.col("n") == 1).select("k", "part", F.col("t").alias("p"))
    objects = role(F.col("n") > 1).select("k", "part", F.col("t").alias("o"))
    joined = objects.join(predicate, ["k", "part"]).join(subject, "k").select("s", "p", "o")
    known = F.broadcast(_prefixes(rows))  # declarations of files' heads, distinct

    def full(df: DataFrame, c: str) -> DataFrame:
        prefixed = F.regexp_extract(c, r"^([\w-]*:)", 1)
        out = df.withColumn("_p", F.when(F.col(c).rlike(r"^(?!_:)[\w-]*:"), prefixed)).join(known.withColumnsRenamed({"prefix": "_p", "base": "_b"}), "_p", "left")
        local = F.substring_index(c, ":", -1)
        name = F.when(F.col(c).startswith("<"), F.regexp_replace(c, "^<|>$", "")).when(F.col("_b").isNotNull(), F.concat("_b", local)).when(F.col(c) == "a", F.lit(f"{RDF}type")).otherwise(F.col(c))
        return out.withColumn(c, name).drop("_p", "_b")

    literal = F.col("o").startswith('"')
    lang = F.when(literal, F.regexp_extract("o", r'"@([A-Za-z][A-Za-z0-9-]*)$', 1))
    body = F.regexp_replace(F.regexp_replace("o", r'^("""|")', ""), r'("""|")(@[A-Za-z0-9-]+|\^\^.*)?$', "")
    for mark, letter in (("\\\"", '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")):
        body = F.replace(body, F.lit(mark), F.lit(letter))
    split = joined.withColumn("lang", lang)
    words = split.filter(literal).withColumn("o", body)
    names = full(split.filter(~literal), "o")
    return full(full(words.unionByName(names), "s"), "p").select("s", "p", "o", "lang")


def labels(of: DataFrame, languages: tuple[str, ...] = ("en", "")) -> DataFrame:
    """(node, label) of everything that is a concept or has a label: the best kind of label, then the first language of the list, then
    any, then the least; without one the last part of its address. White space is made single."""
    kind = F.coalesce(*(F.when(F.col("p") == p, k) for k, p in enumerate(LABELS)))
    place = F.coalesce(*(F.when(F.col("lang") == x, k) for k, x in enumerate(languages)), F.lit(len(languages)))
    text = F.trim(F.regexp_replace("o", r"\s+", " "))
    said = of.filter(F.col("p").isin(*LABELS)).select(F.col("s").alias("node"), kind.alias("kind"), place.alias("place"), F.when(F.col("lang").isNotNull() & (text != ""), text).alias("text"))
    concepts = of.filter((F.col("p") == f"{RDF}type") & (F.col("o") == f"{SKOS}Concept")).select(F.col("s").alias("node"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("text"))
    best = said.unionByName(concepts).groupBy("node").agg(F.min(F.when(F.col("text").isNotNull(), F.struct("kind", "place", "text"))).alias("x"))
    return best.select("node", F.coalesce("x.text", F.regexp_extract("node", r"([^/#]*)[/#]?$", 1)).alias("label"))


def paths(of: DataFrame, broader: str = f"{SKOS}broader", most: int = 1000) -> DataFrame:
    """(path array, leaf) from each root to each leaf over labelled nodes, by every way there is. A node may have several parents. A
    step back into a path is not taken: a node with no other step ends it. Where every node has a parent (cycles alone),
    nothing is a root. One round a level; over ``most`` levels is an error."""
    named = kept(labels(of), "labels")
    own = of.filter(F.col("p") == broader).select(F.col("o").alias("parent"), F.col("s").alias("child")).distinct()
    edges = kept(own.join(named.select(F.col("node").alias("parent")), "parent", "left_semi").join(named.select(F.col("node").alias("child")), "child", "left_semi").filter("parent <> child"), "broader")
    now = named.select(F.col("node").alias("leaf")).join(edges.select(F.col("child").alias("leaf")), "leaf", "left_anti").select("leaf", F.array("leaf").alias("nodes"))
    done = None
    for _ in range(most):
        now = kept(now, "paths")
        step = now.join(edges.select(F.col("parent").alias("leaf"), "child"), "leaf").filter(~F.array_contains("nodes", F.col("child")))
        step = kept(step.select(F.col("child").alias("leaf"), F.array_append("nodes", F.col("child")).alias("nodes"), F.col("nodes").alias("before")), "steps")
        ended = now.join(step.select(F.col("before").alias("nodes")).distinct(), "nodes", "left_anti")
        done = ended if done is None else done.union(ended)
        if step.isEmpty():
            break
        now = step.select("leaf", "nodes")
    else:
        raise ValueError(f"paths of over {most} levels")
    told = done.select("leaf", "nodes", F.posexplode("nodes").alias("i", "node")).join(named, "node")
    return told.groupBy("nodes", "leaf").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("x")).select(F.col("x.label").alias("path"), "leaf")
