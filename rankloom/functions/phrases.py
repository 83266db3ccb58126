"""Names, phrases, acronyms, addresses and loosely written answers as Spark columns: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells sizes and tunings in a model's name.
TUNINGS = ("chat", "instruct", "base", "code", "mini")
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those", "some", "any")


def author_of(c: Column) -> Column:
    """What precedes the first slash of author/name; Unknown without one."""
    return F.when(F.contains(c, F.lit("/")), F.substring_index(c, "/", 1)).otherwise("Unknown")


def after_slash(c: Column) -> Column:
    """What follows the first slash, all of it without one."""
    return F.regexp_replace(c, "^[^/]*/", "")


def initials(words: Column) -> Column:
    """One letter for each word, so that a place in the initials is the place of a word."""
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def expansion(words: Column, acronym: Column) -> Column:
    """The first run of words whose initials spell the acronym, null if there is none."""
    at = F.instr(initials(words), F.lower(acronym))
    return F.when((at > 0) & (F.length(acronym) > 0), F.array_join(F.slice(words, F.greatest(at, F.lit(1)), F.length(acronym)), " "))


def phrase_variants(c: Column) -> Column:
    """'full (acr)' as full, acr and 'full acr'; a phrase without brackets as itself."""
    full, acr = F.trim(F.regexp_extract(c, r"^(.*?)\(", 1)), F.trim(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    return F.when(acr != "", F.array(full, acr, F.concat_ws(" ", full, acr))).otherwise(F.array(c))


def tolerant_pattern(name: Column) -> Column:
    """A pattern for a name whose separators may be a space, a hyphen, an underscore or nothing."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.concat(F.lit(r"\b"), F.array_join(parts, "[ _-]?"), F.lit(r"\b"))


def mention_variants(c: Column) -> Column:
    """Ways to mention org/name: whole, name alone, separators as spaces, all lower-cased and distinct."""
    low = F.lower(c)
    name = after_slash(low)
    return F.array_sort(F.array_distinct(F.array(low, name, F.regexp_replace(name, "[-_.]+", " "), F.regexp_replace(low, "/", " "))))


def camel_words(c: Column) -> Column:
    """camelCase and separators as words, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))


def name_parts(c: Column) -> tuple[Column, Column, Column]:
    """(family: words that are neither a size nor a tuning, size in billions or null, tuning or null) of a model's name."""
    words = camel_words(c)
    size = F.regexp_extract(F.lower(c), r"(?:^|[^a-z0-9])([0-9]+)b(?:$|[^a-z0-9])", 1)
    family = F.array_join(F.filter(words, lambda w: ~w.isin(*TUNINGS) & ~w.rlike("^[0-9]+b?$")), " ")
    return family, F.when(size != "", size.cast("long")), F.get(F.filter(words, lambda w: w.isin(*TUNINGS)), F.lit(0))


def canonical_phrase(c: Column) -> Column:
    """Hyphens and underscores as spaces, lower case but for words all in capitals, no determiner in front, the last word
    without its plural s."""
    words = F.filter(F.split(F.regexp_replace(c, r"[-_\s]+", " "), " "), lambda w: F.length(w) > 0)
    words = F.transform(words, lambda w: F.when(w.rlike("^[A-Z][A-Z0-9]+$"), w).otherwise(F.lower(w)))
    words = F.filter(words, lambda w, i: (i > 0) | ~w.isin(*DETERMINERS))
    return F.regexp_replace(F.array_join(words, " "), "([a-z]{2,}[^s])s$", "$1")


def compact_phrase(c: Column) -> Column:
    """Brackets with what they hold out, 'label: rest' as rest, separators as spaces, generic ends out."""
    c = F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)", " "), r"^[^:]{1,20}:\s*", "")
    c = F.trim(F.regexp_replace(c, r"[\s/|,;]+", " "))
    return F.regexp_replace(c, " (model|models|task|tasks|system|systems)$", "")


def snippet(text: Column, name: Column, around: int) -> Column:
    """The text around the first mention of a name, ``around`` characters on each side; its start if there is none."""
    at = F.instr(F.lower(text), F.lower(name))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(name) + around)).otherwise(F.substring(text, 1, 2 * around))


def chunks(parts: Column, most: int, by: str = "\n") -> Column:
    """Parts joined greedily into chunks of at most ``most`` characters; a longer part is a chunk of its own."""
    cut = "\x1f"
    last = lambda acc: F.substring_index(acc, cut, -1)
    step = lambda acc, x: F.when(acc == "", x).when(F.length(last(acc)) + len(by) + F.length(x) <= most, F.concat(acc, F.lit(by), x)).otherwise(F.concat(acc, F.lit(cut), x))
    return F.split(F.aggregate(F.filter(parts, lambda p: F.length(p) > 0), F.lit(""), step), cut)


def kept_lines(text: Column) -> Column:
    """Lines that are not rules of tables, dumps of numbers or traces."""
    noisy = r"^[\s|:+=-]{3,}$|^\s*(Traceback|File \"|at [\w.$]+\()"
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(noisy) & (F.regexp_count(x, F.lit("[0-9]")) * 2 <= F.length(x)))


def clean_lines(text: Column) -> Column:
    """The kept lines with addresses as [URL] and [EMAIL]."""
    return F.regexp_replace(F.regexp_replace(F.array_join(kept_lines(text), "\n"), r"https?://[^\s]+", "[URL]"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")


def content_words(text: Column, stop: tuple[str, ...], keep: tuple[str, ...] = ("no", "not", "never")) -> Column:
    """Words without the stop words, but with negations, plural s off words of four letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    words = F.filter(words, lambda w: w.isin(*keep) | ~w.isin(*stop))
    return F.transform(words, lambda w: F.regexp_replace(w, "^([a-z]{3,}[^s])s$", "$1"))


def shared_stem(a: Column, b: Column, least: int = 3) -> Column:
    """Some word of a is in a word of b or the other way about, at ``least`` letters or more."""
    return F.exists(a, lambda x: F.exists(b, lambda y: ((F.length(x) >= least) & F.contains(y, x)) | ((F.length(y) >= least) & F.contains(x, y))))


def first_seen(items: Column) -> Column:
    """Items once each whatever their case, in the form and order first seen."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def clean_url(c: Column) -> Column:
    """Without query, fragment and slashes at the end, scheme and host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z]+://[^/]*", 0)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def grade(c: Column) -> Column:
    """The number after 'grade' or 'score' in an answer, else its first number; ten times it if it is at most 1. Else null."""
    named = F.regexp_extract(F.lower(c), r"(?:grade|score)[^0-9]{0,5}([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(named != "", named).otherwise(F.regexp_extract(c, r"[0-9]+(?:\.[0-9]+)?", 0))
    number = F.when(value != "", value).cast("double")
    return F.when(number <= 1, number * 10).otherwise(number)


def numbered_answers(c: Column) -> Column:
    """yes, no and maybe of the lines '1. Yes', '2) no ...', in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+[.)] *(yes|no|maybe)"), F.lit(1))


def list_cell(c: Column) -> Column:
    """A list written in a cell: a literal list, else split at line ends, semicolons or commas, whichever comes first."""
    inner = F.regexp_replace(c, r"^\s*\[|\]\s*$", "")
    literal = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    by = lambda sep: F.transform(F.split(c, sep), lambda x: F.trim(x))
    cells = F.when(c.rlike(r"^\s*\["), literal).when(F.contains(c, F.lit("\n")), by("\n")).when(F.contains(c, F.lit(";")), by(";")).otherwise(by(","))
    return F.filter(cells, lambda x: F.length(x) > 0)


def one_alternative(c: Column) -> Column:
    """'(_)' and '(-)' out, of '{b|a}' the first in order."""
    c = F.trim(F.regexp_replace(c, r"\s*\([_-]\)", ""))
    choice = F.array_min(F.split(F.regexp_extract(c, r"\{([^}]*)\}", 1), r"\|"))
    return F.when(c.rlike(r"\{[^}]*\}"), F.concat(F.regexp_extract(c, r"^([^{]*)\{", 1), choice, F.regexp_extract(c, r"\}(.*)$", 1))).otherwise(c)
