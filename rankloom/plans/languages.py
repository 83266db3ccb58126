"""Queries of language tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import languages

from .catalogue import table
from .registry import query

#: Three-letter, two-letter, terminological and bibliographic codes and names, as ISO 639 has them.
REFERENCE = [("eng", "en", "eng", "eng", "English"), ("fra", "fr", "fra", "fre", "French"), ("deu", "de", "deu", "ger", "German"), ("spa", "es", "spa", "spa", "Spanish"), ("nld", "nl", "nld", "dut", "Dutch"), ("zho", "zh", "zho", "chi", "Chinese"), ("gsw", "", "gsw", "gsw", "Swiss German"), ("nds", "", "nds", "nds", "Low German"), ("frm", "", "frm", "frm", "Middle French (ca. 1400-1600)"), ("cpe", "", "", "", "English based Creole")]
SPECIAL = [("multilingual", "mul", "Multiple languages"), ("code", "", "Code")]
SYNONYMS = [("castilian", "Spanish"), ("mandarin", "zh"), ("flemish", "Dutch"), ("deutsch", "German")]


def forms(spark, d):
    """Each document's tag in one of several forms, by its id: code, region, name, alias, mention, special, unknown."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    name = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", "German").when(F.col("lang") == "es", "Castilian")
    k = F.col("doc_id") % 8
    tag = F.when(k == 0, F.col("lang")).when(k == 1, F.concat("lang", F.lit("_"), F.upper("lang"))).when(k == 2, F.upper(name)).when(k == 3, F.concat(F.lit("old  swiss "), name, F.lit(" corpus"))).when(k == 4, F.concat(F.lit("in "), name)).when(k == 5, "Multilingual").when(k == 6, F.concat(F.lit("x"), "lang", F.lit(" 12")))
    return docs.withColumn("tag", tag)


@query("""WITH f AS (SELECT doc_id, doc_id % 8 AS k, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Castilian' END AS name FROM documents),
    h AS (SELECT doc_id, k, name IS NOT NULL AS known, CASE WHEN k = 3 AND lang = 'de' THEN 'gsw' ELSE CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END END AS iso3, lang FROM f)
    SELECT doc_id, CASE WHEN k = 5 THEN 'mul' WHEN k < 5 AND known THEN iso3 END AS iso3, CASE WHEN k = 5 THEN 'Multiple languages' WHEN k < 5 AND known THEN CASE iso3 WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' WHEN 'deu' THEN 'German' WHEN 'gsw' THEN 'Swiss German' ELSE 'Spanish' END END AS language,
      CASE WHEN k = 5 THEN 'special' WHEN NOT known THEN NULL WHEN k IN (0, 1) THEN 'code' WHEN k = 2 THEN CASE WHEN lang = 'es' THEN 'synonym' ELSE 'name' END WHEN k IN (3, 4) THEN 'mention' END AS found_by FROM h""")
def language_chain(spark, d):
    """Tags resolved by special tag, code, region, name, alias and the longest name in them."""
    reference = spark.createDataFrame(REFERENCE, "iso3 string, part1 string, part2t string, part2b string, name string")
    special, synonyms = spark.createDataFrame(SPECIAL, "tag string, iso3 string, name string"), spark.createDataFrame(SYNONYMS, "alias string, target string")
    return languages.resolved(forms(spark, d), "tag", reference, special, synonyms).select("doc_id", "iso3", "language", "found_by")
