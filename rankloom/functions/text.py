"""Text functions as Spark columns: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = [("url", r"https?://[^\s]+"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]"), ("path", r"(?:[A-Za-z]:\\|~/|\./|/)[A-Za-z0-9_.-]+(?:[/\\][A-Za-z0-9_.-]+)+")]


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.when(c.rlike(r"[\t\n\x0B\f\r]|  "), F.trim(F.regexp_replace(c, r"\s+", " "))).otherwise(F.trim(c))


def normal_text(c: Column) -> Column:
    """Lower case; __ as /, no .json at the end, - and _ as spaces; what reads as a boolean becomes true or false."""
    low = squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "__", "/"), r"\.json$", ""), "[_-]+", " "))
    return F.when(low.isin("true", "1", "yes", "y"), "true").when(low.isin("false", "0", "no", "n"), "false").otherwise(low)


def token_signature(c: Column) -> Column:
    """The [a-z0-9]+ tokens, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def value_key(c: Column) -> Column:
    """The shortest (then first) of the normal forms with and without a license: or dataset: prefix."""
    low = normal_text(c)
    bare = F.trim(F.regexp_replace(low, r"^(license|dataset):", ""))
    return F.when((F.length(bare) < F.length(low)) | ((F.length(bare) == F.length(low)) & (bare < low)), bare).otherwise(low)


def aliases(c: Column, most: int = 128) -> Column:
    """Case, separator and compact forms, distinct and sorted."""
    base = squeeze(c)
    forms = [base, F.lower(base), F.upper(base), F.initcap(base), F.regexp_replace(base, "[ _-]+", "-"), F.regexp_replace(base, "[ _-]+", "_"), F.regexp_replace(base, "[ _-]+", " "), F.regexp_replace(base, "[^A-Za-z0-9]+", "")]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda x: (F.length(x) > 0) & (F.length(x) <= most))))


def plain_phrase(c: Column) -> Column:
    """Lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def markdown_to_text(c: Column) -> Column:
    """Fences and images out, links as their label, code spans as their inside, markers, tables' rules and tags out."""
    for pattern, by in ((r"(?s)^---\n.*?\n---\n", ""), (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"(?s)<[^>]+>", " "), (r"(?m)^[ \t]*[|:-]{3,}[ \t]*$", " "), (r"(?m)^[ \t]*(#{1,6}|[*+>-])[ \t]+", ""), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"), (r'["\\]', "")):
        c = F.regexp_replace(c, pattern, by)
    return squeeze(c)


def html_to_text(c: Column) -> Column:
    """Scripts, styles, comments and tags out; the five named entities as characters."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return squeeze(c)


def anonymised(c: Column) -> Column:
    """Code spans, URLs, e-mail addresses and paths as placeholders. Texts without any of their signs are only squeezed."""
    marked = F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", "<CODE>"), r"`[^`]+`", "<CODE>")
    for name, pattern in PLACEHOLDER:
        marked = F.regexp_replace(marked, pattern, f"<{name.upper()}>")
    return squeeze(F.when(c.rlike(r"[`@/\\]"), marked).otherwise(c))


def sentences(c: Column) -> Column:
    """Split after . ! or ? and white space; empty ones out."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) > 0)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)


def has_phrase(text: Column, phrase: Column) -> Column:
    """The phrase occurs with no letter or digit beside it (both lower-cased)."""
    quoted = F.regexp_replace(F.lower(phrase), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def without_repeats(c: Column) -> Column:
    """Adjacent equal words once."""
    w = words(c)
    return F.array_join(F.filter(w, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(w, i - 1)))), " ")


def is_acronym(c: Column) -> Column:
    return F.regexp_like(c, F.lit("^[A-Z][A-Z0-9]{1,7}$"))


def json_body(c: Column) -> Column:
    """The object in a loosely written answer: a fenced block, else from the first to the last brace, else null."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.length(fenced) > 0, fenced).when(F.length(braces) > 0, braces)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct items by the size of the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
