"""Answers that models give as JSON: fences off, a parse that keeps what it can't read, defaults by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: What a missing key stands for; a missing response is the answer's own text.
FOUND, CONFIDENCE = "true", "medium"
_STRICT = {"allowSingleQuotes": "false"}


def unfenced(text: Column) -> Column:
    """Without a fence of three back-ticks (with `json` after the first ones or not), one of single ones, or a leading `json`, of which the
    first that fits goes; then without backslashes and white space at the end."""

    def bare(t: Column) -> Column:
        between = lambda first, last: F.endswith(t, F.lit(last)) & F.startswith(t, F.lit(first))
        inner = lambda first, last: X.stripped(F.substr(t, F.lit(first + 1), F.greatest(F.length(t) - first - last, F.lit(0))))
        return F.when(between("```json", "```"), inner(7, 3)).when(between("```", "```"), inner(3, 3)).when(between("`", "`"), inner(1, 1)).when(F.startswith(t, F.lit("json")), inner(4, 0)).otherwise(t)

    return X.stripped(F.regexp_replace(X.bound(X.stripped(text), bare), r"[\\\s]*$", ""))


def members(text: Column) -> Column:
    """The members of a JSON object, nested values as their JSON; null for what is no object, is broken, or goes on after its end."""

    def inner(around: Column) -> Column:
        return F.when((F.size(around) == 2) & (F.element_at(around, "end") == "1"), F.from_json(F.element_at(around, "x"), "map<string,string>", _STRICT))

    # The object stands as a member of another one: only a whole one leaves the member after it in place.
    around = lambda t: F.from_json(F.concat(F.lit('{"x":'), t, F.lit(',"end":1}')), "map<string,string>", _STRICT)
    return X.bound(text, lambda t: F.when(t.rlike(r"^\s*\{"), X.bound(around(t), inner)))


def answer(text: Column) -> Column:
    """found_answer, confidence, response and `unread`, the text where it could not be parsed (else null). A key with a null value
    stays null; a missing one has its default, and so have all keys of a text that can't be parsed. A null text is one of those."""

    def told(t: Column, m: Column) -> Column:
        value = lambda key, default: F.when(F.coalesce(F.map_contains_key(m, key), F.lit(False)), F.element_at(m, F.lit(key))).otherwise(default)
        return F.struct(value("found_answer", F.lit(FOUND)).alias("found_answer"), value("confidence", F.lit(CONFIDENCE)).alias("confidence"), value("response", t).alias("response"), F.when(m.isNull(), t).alias("unread"))

    return X.bound(text, lambda t: X.bound(members(t), lambda m: told(t, m)))
