"""Text as Columns: tokens, sentences, n-grams, overlaps. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that are stripped from the ends of tokens.
PUNCTUATION = ".,!?;:\"'()[]{}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once: a lambda that named it outright would make it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def squeezed(text: Column) -> Column:
    """Lower case, trimmed, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """All matches of ``pattern`` in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def bare_tokens(text: Column, longer_than: int) -> Column:
    """The distinct lower-cased tokens between white space, stripped of punctuation, of more characters than given."""
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > longer_than))


def sentences(text: Column, longer_than: int = 10) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space; trimmed; short ones are left out."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > longer_than)


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` items, joined by a space; none if there are fewer items."""
    none = F.array().cast("array<string>")
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.array_join(F.slice(x, i, n), " "))
    return let(items, lambda x: F.when(F.size(x) >= n, runs(x)).otherwise(none))


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct items over all distinct items; null if there are none."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct items of ``a`` that are in ``b``; null if ``a`` is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether one of the phrases is a substring."""
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def count_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases are substrings."""
    return sum((text.contains(p).cast("int") for p in phrases), F.lit(0))


def count_matches(text: Column, patterns: Iterable[str]) -> Column:
    """Matches of all patterns together."""
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
