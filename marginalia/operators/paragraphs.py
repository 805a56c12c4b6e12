"""From a page's text spans to its paragraphs: notes set apart, columns, lines, and the lines that begin a paragraph.

All windows and groups begin with the keys of a page, so that spans are shuffled once, by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import layout

PAGE = ["pdf_filename", "page_number"]
BOX = ["x0", "y0", "x1", "y1"]
# Starts of paragraphs, and of notes, the first two of which tell a single note by its span.
STARTS = [r"^\p{Nd}+\.", r"^[A-Z][a-z]+:", r"^[•*-]"]
NOTES = [r"^\p{Nd}+[\s.]", r"^[*†‡]"]
NOTE_LINES = [r"^\p{Nd}+[\s.]", r"^[*†‡§¶]", r"(?i)^[ivxlcdm]+[\s.]"]


def begins(line: Column) -> Column:
    """Looks like a paragraph's first line: a capital and some length, or a number, label or bullet."""
    return (line.rlike(r"^\p{Lu}") & (F.length(line) > 20)) | X.matches(line, STARTS)


def continues(before: Column, line: Column) -> Column:
    """Goes on with the sentence before, which has no end, or begins without a capital, or is a fragment."""
    ended = F.right(before, F.lit(1)).isin(*".!?:;")
    return ~ended | ~line.rlike("^[A-Z]") | ((F.size(X.words(line)) <= 8) & (F.length(line) < 50))


def first_mode(items: Column) -> Column:
    """The most frequent item of an array, nulls counted too; of equally frequent ones the first."""
    counted = F.transform(F.array_distinct(items), lambda v, k: F.struct(F.size(F.filter(items, lambda w: w.eqNullSafe(v))).alias("n"), (-k).alias("k"), v.alias("v")))
    return F.array_max(counted)["v"]


def in_parts(spans: DataFrame, low: float = 0.2, small: float = 10.0, gutter: float = 30.0, least: int = 3) -> DataFrame:
    """Spans with `note` and `column`.

    A note is small print in the lowest fifth of what the page covers, with a note's sign unless several spans are that low. Among the
    others, a gap of more than `gutter` between neighbouring left edges parts two columns if more than `least` spans are right of it.
    """
    page = Window.partitionBy(*PAGE)
    bottom = F.max("y1").over(page)
    deep = spans.withColumn("_deep", F.col("y0") > bottom - (bottom - F.min("y0").over(page)) * low)
    several = F.sum(F.col("_deep").cast("int")).over(page) > 1
    noted = deep.withColumn("note", F.col("_deep") & (F.col("font_size") < small) & (several | X.matches(X.stripped(F.col("content")), NOTES))).drop("_deep")
    part = Window.partitionBy(*PAGE, "note")
    across = part.orderBy("x0", "ord")
    right = F.count(F.lit(1)).over(part) - F.row_number().over(across) + 1
    edge = ~F.col("note") & (F.col("x0") - F.lag("x0").over(across) > gutter) & (right > least)
    return noted.withColumn("_edge", F.coalesce(edge.cast("int"), F.lit(0))).withColumn("column", F.sum("_edge").over(across.rowsBetween(Window.unboundedPreceding, 0))).drop("_edge")


def lines_of(spans: DataFrame, reach: float = 5.0) -> DataFrame:
    """The lines of spans in parts, with their spans in order; lines without text are left out."""
    down = Window.partitionBy(*PAGE, "note", "column").orderBy("y0", "x0", "ord")
    stepped = spans.withColumn("_step", F.coalesce((F.col("y0") - F.lag("y0").over(down) > reach).cast("int"), F.lit(0)))
    placed = stepped.withColumn("line", F.sum("_step").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(down))
    row = F.struct("_at", "content", "font_name", "font_size", "bold")
    lines = placed.groupBy(*PAGE, "note", "column", "line").agg(F.sort_array(F.collect_list(row)).alias("spans"), *(f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)))
    return lines.withColumn("text", X.stripped(F.array_join(F.col("spans.content"), " "))).filter("text <> ''")


def span_paragraphs(spans: DataFrame, apart: float = 15.0, least: int = 3) -> DataFrame:
    """(pdf_filename, page_number, place, block_type, content, x0, y0, x1, y1, font_size_min, font_size_max, font_size, font_name, has_bold,
    line_count, span_count) of spans: pdf_filename, page_number, ord, content, x0, y0, x1, y1, font_name, font_size, font_weight.

    A line begins a paragraph that is first in its column, lies more than `apart` below the line before, looks like a first line and doesn't
    continue the line before, or looks like a note. Paragraphs of fewer than `least` characters go. The font is the most frequent one, the size
    the mean. Columns come one after the other, notes last. A null text is empty, a null size 12; spans without a whole box are left out;
    spans at one place come by `ord`, and repeated ones are all kept.
    """
    size, bold = F.coalesce(F.col("font_size"), F.lit(12.0)), F.coalesce(F.col("font_weight") == "bold", F.lit(False))
    known = spans.dropna(subset=BOX).select(*PAGE, "ord", *BOX, F.coalesce("content", F.lit("")).alias("content"), "font_name", size.cast("double").alias("font_size"), bold.alias("bold"))
    lines = lines_of(in_parts(known))
    down = Window.partitionBy(*PAGE, "note", "column").orderBy("line")
    before, below, text = F.lag("text").over(down), F.lag("y1").over(down), F.col("text")
    first = before.isNull() | (F.col("y0") - below > apart) | (begins(text) & ~continues(before, text)) | X.matches(text, NOTE_LINES)
    numbered = lines.withColumn("_first", first.cast("int")).withColumn("paragraph", F.sum("_first").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*PAGE, "note", "column", "paragraph").agg(
        F.sort_array(F.collect_list(F.struct("line", "text", "spans"))).alias("l"), *(f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)), F.count(F.lit(1)).alias("line_count")
    )
    p = grouped.withColumns({"content": F.array_join(F.col("l.text"), " "), "s": F.flatten(F.col("l.spans"))}).filter(F.length("content") >= least)
    total = F.aggregate(F.col("s.font_size"), F.lit(0.0), lambda a, v: a + v)
    p = p.withColumns({
        "font_size_min": F.array_min(F.col("s.font_size")), "font_size_max": F.array_max(F.col("s.font_size")), "font_size": total / F.size("s"), "font_name": first_mode(F.col("s.font_name")),
        "has_bold": F.exists(F.col("s.bold"), lambda b: b), "span_count": F.size("s").cast("bigint"),
    })
    text = F.col("content")
    kind = F.when(F.col("note"), "footnote").when(layout.is_heading(text, F.col("font_size"), F.col("has_bold"), F.col("span_count")), "heading").when(layout.is_list_item(text), "list").otherwise("paragraph")
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("note", "column", "paragraph"))
    fonts = ["font_size_min", "font_size_max", "font_size", "font_name", "has_bold", "line_count", "span_count"]
    return p.select(*PAGE, place.cast("bigint").alias("place"), kind.alias("block_type"), "content", *BOX, *fonts)
