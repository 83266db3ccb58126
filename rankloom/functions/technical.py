"""Descriptions out of README files, identifiers out of code, and how technical a phrase looks, as columns.

Null texts give null descriptions, no identifiers and a score of null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notices of gated records.
GATING = r"(?i)(?<![\p{L}\p{N}_])(agree|login|sign[\s-]?up|access this model|conditions?|use this model|you need to)(?![\p{L}\p{N}_])"
FENCE = r"(?s)```.*?```"
LETTER = r"[\p{L}\p{N}_]"
APART = r"(?:^|[^\p{L}\p{N}_])"
IDENTIFIER = r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]*(?:\.[\p{L}_][\p{L}\p{N}_]*)*"
#: Names with an underscore, humps, dots or digits.
LIKE_IDENTIFIER = rf"[A-Za-z]{LETTER}*_[A-Za-z0-9_]|{APART}(?:[a-z]+[A-Z]|[A-Za-z_]{LETTER}*(?:\.[A-Za-z_]|[0-9]))"
ACRONYM = rf"{APART}[A-Z]{{2,}}(?:$|[^\p{{L}}\p{{N}}_])"
EDGES = "[ \t\r\n\"'“”‘’.,;:()\\[\\]{}]+"


def paragraphs(text: Column) -> Column:
    """Parts between empty lines, trimmed; empty ones out."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def readme_description(text: Column, title: Column, gating: str = GATING) -> Column:
    """The prose of a README: no front matter, code, tables, tags, title or gating paragraph.

    Headings begin a paragraph. A first paragraph that ends with the title goes; where every paragraph is a notice, all stay.
    """
    for pattern, by in ((r"(?ms)^---\s*\n.*?\n---\s*\n", ""), (r"(?m)^(#{1,6}\s)", "\n\n$1"), (r"(?ms)^```.*?```", ""), (r"(?m)^\|.*\|$", ""), (r"(?s)<[^>]+>", ""), (r"\A(?:#[^\n]*(?:\n|\z))+", "")):
        text = F.regexp_replace(text, pattern, by)
    every = paragraphs(text)
    titled = F.coalesce(F.endswith(F.lower(F.get(every, F.lit(0))), F.lower(title)), F.lit(False))
    rest = F.when(titled, F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))).otherwise(every)
    prose = F.filter(rest, lambda p: ~p.rlike(gating))
    return F.array_join(F.when(F.size(prose) > 0, prose).otherwise(rest), "\n\n")


def identifiers(text: Column, code: str = FENCE, marks: str = r"^```[^\n]*\n|```$", least: int = 3) -> Column:
    """Distinct names of so many characters at least within code, its marks aside."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(code), F.lit(0)), lambda b: F.regexp_replace(b, marks, ""))
    names = F.regexp_extract_all(F.array_join(inner, " "), F.lit(IDENTIFIER), F.lit(0))
    return F.coalesce(F.filter(F.array_distinct(names), lambda n: F.length(n) >= least), F.array().cast("array<string>"))


def technical_score(phrase: Column, names: Column, hints: Sequence[str]) -> Column:
    """2 each for the form of an identifier, an acronym and a digit or one of % / -, 3 as one of the names or 2 for holding one, 1 for a hint."""
    named = F.when(F.array_contains(names, phrase), 3).when(F.exists(names, lambda n: F.contains(phrase, n)), 2).otherwise(0)
    hinted = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(phrase), h)) if hints else F.lit(False)
    return 2 * phrase.rlike(LIKE_IDENTIFIER).cast("int") + 2 * phrase.rlike(ACRONYM).cast("int") + 2 * phrase.rlike("[0-9%/-]").cast("int") + named + hinted.cast("int")


def bare(phrase: Column) -> Column:
    """White space as single spaces, quotes, brackets and stops off both ends."""
    return F.regexp_replace(F.regexp_replace(phrase, r"\s+", " "), f"^{EDGES}|{EDGES}$", "")


def worth_scoring(phrase: Column, stop: Sequence[str], deny: Sequence[str] = (), least: int = 3, most: int = 80, share: float = 0.6) -> Column:
    """A phrase of a length within bounds, not denied, with stop words as no more than a share of its words."""
    words = F.split(F.lower(phrase), " ")
    stops = F.size(F.filter(words, lambda w: w.isin(*stop)))
    return F.length(phrase).between(least, most) & (stops <= share * F.size(words)) & ~F.lower(phrase).isin(*deny)
