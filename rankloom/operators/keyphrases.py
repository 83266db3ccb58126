"""Candidate phrases without a tagger: runs of words between stop words and marks, scored by how their words keep company.

candidates   the runs, one by one with their document
scored       of each phrase its occurrences, documents and score: the sum over its words of degree by frequency, a word's degree
             being the words of all runs it is in (itself included), its frequency the runs it is in, each as often as it is there
heads        of each phrase its head: the word that most often ends the runs it is in, later ones first; what stands before it modifies
parents      of each phrase the longest phrase that remains when words in front are left out and that is a run elsewhere too

Words are runs of letters in lower case, apostrophes within them. Nulls and empty texts have no candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import kept

#: A letter run, or a mark that ends a phrase.
PIECES = r"\p{L}+(?:'\p{L}+)*|[^\p{L}\s]"


def candidates(docs: DataFrame, id_col: str, text_col: str, stop: tuple[str, ...]) -> DataFrame:
    """(id, phrase): every run, repeats included."""
    pieces = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(PIECES), F.lit(0))
    words = F.transform(pieces, lambda w: F.when(w.isin(*stop) | ~w.rlike(r"^\p{L}"), "|").otherwise(w))
    runs = F.filter(F.transform(F.split(F.array_join(words, " "), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("phrase"))


def _numbered(phrases: DataFrame) -> DataFrame:
    """Distinct phrases as a table with a number each, by which their words are followed: the text itself is shuffled no more."""
    return kept(phrases.withColumn("_no", F.monotonically_increasing_id()), "phrases")


def counted(runs: DataFrame) -> DataFrame:
    """(phrase, n), numbered."""
    return _numbered(runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")))


def word_scores(phrases: DataFrame) -> DataFrame:
    """(word, freq, degree, ends): how often a word is in a run, the words of those runs, how often it ends one. Takes phrases with
    their counts n, so a phrase is taken apart once however often it occurs."""
    words = F.split("phrase", " ")
    each = phrases.select("n", F.size(words).alias("size"), F.posexplode(words).alias("i", "word"))
    return each.groupBy("word").agg(F.sum("n").alias("freq"), F.sum(F.col("n") * F.col("size")).alias("degree"), F.sum(F.when(F.col("i") == F.col("size") - 1, F.col("n")).otherwise(0)).alias("ends"))


def _with_words(phrases: DataFrame) -> DataFrame:
    """(_no, i, freq, degree, ends) of each word of numbered phrases."""
    return phrases.select("_no", F.posexplode(F.split("phrase", " ")).alias("i", "word")).join(word_scores(phrases), "word").drop("word")


def scored(runs: DataFrame) -> DataFrame:
    """(phrase, n, n_docs, score)."""
    by_doc = runs.groupBy("phrase", "id").agg(F.count(F.lit(1)).alias("k"))
    phrases = _numbered(by_doc.groupBy("phrase").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs")))
    score = _with_words(phrases).groupBy("_no").agg(F.sum(F.col("degree") / F.col("freq")).alias("score"))
    return phrases.join(score, "_no").select("phrase", "n", "n_docs", "score")


def heads(runs: DataFrame) -> DataFrame:
    """(phrase, head, modifiers)."""
    phrases = counted(runs)
    best = _with_words(phrases).groupBy("_no").agg(F.max(F.struct((F.col("ends") / F.col("freq")).alias("share"), "i")).alias("h"))
    words = F.split("phrase", " ")
    before = F.array_join(F.slice(words, F.lit(1), F.col("h.i")), " ")
    return phrases.join(best, "_no").select("phrase", F.get(words, F.col("h.i")).alias("head"), before.alias("modifiers"))


def parents(runs: DataFrame) -> DataFrame:
    """(phrase, parent, modifier), for phrases that have one."""
    phrases = _numbered(runs.select("phrase").distinct())
    words = F.split("phrase", " ")
    tails = phrases.select("_no", words.alias("w")).filter(F.size("w") > 1).select("_no", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i + 1, F.size("w")), " "))).alias("left", "parent"))
    met = tails.join(phrases.select(F.col("phrase").alias("parent")), "parent", "left_semi")
    best = met.groupBy("_no").agg((F.min("left") + 1).alias("k"))  # words left out; the fewest leave the longest
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    return phrases.join(best, "_no").select("phrase", part(F.col("k") + 1, F.size(words)).alias("parent"), part(F.lit(1), F.col("k")).alias("modifier"))
