"""Text searched in a page's spans, and the spans that a hit covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

PAGE = ["pdf_filename", "page_number"]
#: Characters around a hit in normalised text, whose offsets are near those of the raw text but not the same.
AROUND = 50

# What normalising keeps and replaces.
QUOTES, DASHES, DROPPED = "[\"']", "[–—]", r"[^A-Za-z0-9_\s\-\".,;:!?()\[\]]"


def normalised(text: Column) -> Column:
    """White space as single blanks, quotes and dashes as plain ones, other signs and letters beyond ASCII out, lower case, no blanks at the ends."""
    t = F.regexp_replace(text, r"\s+", " ")
    for pattern, plain in ((QUOTES, '"'), (DASHES, "-"), (DROPPED, "")):
        t = F.regexp_replace(t, pattern, plain)
    return X.stripped(F.lower(t))


def hits(spans: DataFrame, wanted: DataFrame, plain: bool = True) -> DataFrame:
    """(query_id, page_number, place, ord): the spans that show each wanted text (query_id, pdf_filename, page_number, text) on its page or the two beside it.

    A page's text is that of its spans (pdf_filename, page_number, ord, content), without white space at their ends, each followed by a
    blank. Its first place that equals the wanted text counts, `place` from 0, and all spans that touch it are given. With `plain` both are
    normalised first; the place in the page's normalised text is then taken with `AROUND` characters on both sides in the raw
    one. Blank spans are none; a blank or null text, or one of a null page, is found nowhere.
    """
    s = spans.select(*PAGE, "ord", X.stripped(F.col("content")).alias("t")).filter("t <> ''")
    before = Window.partitionBy(*PAGE).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = s.select(*PAGE, "ord", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)).alias("first"), F.length("t").alias("size"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"])
    pages = s.groupBy(*PAGE).agg(F.concat(F.array_join(whole, " "), F.lit(" ")).alias("page_text"))
    form = normalised if plain else lambda c: c
    pages = pages.select(*PAGE, form(F.col("page_text")).alias("shown"), F.length("page_text").alias("long"))
    asked = wanted.select("query_id", "pdf_filename", F.explode(F.sequence(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number"), form(F.col("text")).alias("sought")).filter(F.col("sought").rlike(r"\S"))
    found = asked.join(pages, PAGE).withColumn("place", F.instr("shown", F.col("sought")) - 1).filter("place >= 0")
    around = AROUND if plain else 0
    first, last = F.greatest(F.col("place") - around, F.lit(0)), F.col("place") + F.length("sought") + around
    found = found.select("query_id", *PAGE, "place", first.alias("begin"), (F.least(last, F.col("long")) if plain else last).alias("end"))
    touch = (F.col("first") <= F.col("end")) & (F.col("first") + F.col("size") >= F.col("begin"))
    return found.join(placed, PAGE).filter(touch).select("query_id", "page_number", "place", "ord")
