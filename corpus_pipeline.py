"""A training-corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes what its predecessor kept, whole, and (but for the last) returns the columns of documents, whatever
they are called. Rows without an id take part as any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import byte_bpe, decontaminate, pii, quality_rules, simhash
from rankloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the decision list rejects."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that operator 9's links join (SimHash within 3 bits) or those of
    similar texts beyond them (five-word shingles, 0.8 or more)."""
    return simhash.representatives(docs, radius=simhash.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark segment."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms redacted."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("byte BPE", tokens)]

#: The learned stages have no SQL; tests/llm holds the operators against brute-force versions, and the stages together
#: against one built from those.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result a table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
