"""Text functions from Column to Column. All stay in the JVM; character classes are explicit, as dialects differ."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squashed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return stripped(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """The default counter: 1.3 tokens a word."""
    return F.size(words(text)) * F.lit(1.3)


def sentences(text: Column) -> Column:
    """Parts between runs of . ! ? without white space at the ends, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), stripped), lambda s: s != "")


def occurrences(text: Column, part: Column) -> Column:
    """Times that part is in text without overlap; 0 for an empty part."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def matches(text: Column, patterns: list[str], any_case: bool = False) -> Column:
    return any_of(text.rlike(("(?i)" if any_case else "") + p) for p in patterns)


def holds(text: Column, parts: list[str]) -> Column:
    return any_of(F.contains(text, F.lit(p)) for p in parts)


def is_upper(text: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def is_title(text: Column) -> Column:
    """Upper case only after uncased characters, lower case only after cased ones, and some cased letter."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")


def partly_equal(a: Column, b: Column) -> Column:
    """Either holds the other, in any case; an empty one is in all."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct words of both that both have; 0 if none has any."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0)).cast("double")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")
