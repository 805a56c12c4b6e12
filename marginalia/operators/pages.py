"""Whole pages by range or section, and the intervals of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_TOKENS, MOST_PAGES = 750, 10


def section_ranges(toc: DataFrame, last_pages: int = 10) -> DataFrame:
    """(pdf_filename, title, start_page, end_page): to the page before the next entry's; the last section spans `last_pages` more."""
    pages = toc.select("pdf_filename", "page_number").distinct().withColumn("next", F.lead("page_number").over(Window.partitionBy("pdf_filename").orderBy("page_number")))
    return toc.join(pages, ["pdf_filename", "page_number"]).select("pdf_filename", "title", F.col("page_number").alias("start_page"), F.coalesce(F.col("next") - 1, F.col("page_number") + last_pages).alias("end_page"))


def merged(ranges: DataFrame, by: str = "pdf_filename") -> DataFrame:
    """(by, start_page, end_page): overlapping or touching ranges as one."""
    order = Window.partitionBy(by).orderBy("start_page", "end_page")
    reach = F.max("end_page").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start_page") > F.col("reach") + 1).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("reach", reach).withColumn("island", island).groupBy(by, "island").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).drop("island")


def full_pages(pages: DataFrame, document: str, first: int, last: int, budget: int = 6000) -> DataFrame:
    """The pages that are not blank of a range that is small enough; none if it is too large."""
    n = last - first + 1
    fits = 0 < n <= MOST_PAGES and n * PAGE_TOKENS <= budget
    own = pages.filter((F.col("pdf_filename") == document) & F.col("page_number").between(first, last) & F.col("content").rlike(r"\S") & F.lit(fits))
    return own.select(F.concat("pdf_filename", F.lit(":page:"), "page_number").alias("id"), "pdf_filename", "page_number", "content", F.lit(1.0).alias("score"), (F.col("page_number") - first + 1).alias("rank"))


def pages_of_sections(pages: DataFrame, toc: DataFrame, titles: list[str], budget: int = 8000) -> DataFrame:
    """Pages of the named sections, if all of them together are few enough and each range has a page; else none."""
    wanted = section_ranges(toc).filter(F.col("title").isin(*titles))
    spans = merged(wanted)
    whole = Window.partitionBy()
    total = F.sum(F.col("end_page") - F.col("start_page") + 1).over(whole)
    spans = spans.withColumn("total", total).filter((F.col("total") <= MOST_PAGES) & (F.col("total") * PAGE_TOKENS <= budget))
    p = pages.filter(F.col("content").rlike(r"\S")).select(F.col("pdf_filename").alias("p"), "page_number", "content")
    found = spans.join(p, (F.col("pdf_filename") == F.col("p")) & F.col("page_number").between(F.col("start_page"), F.col("end_page")), "left")
    return found.withColumn("empty", F.max(F.col("page_number").isNull()).over(whole)).filter("not empty").select("pdf_filename", "page_number", "content")


def parsed_range(text):
    """(first, last) of "a-b" with a below b, else null."""
    parts = F.split(text, "-")
    first, last = parts[0].cast("bigint"), parts[1].cast("bigint")
    return F.when(text.rlike(r"^\d{1,9}-\d{1,9}$") & (F.regexp_extract(text, r"^(\d+)-", 1).cast("bigint") < F.regexp_extract(text, r"-(\d+)$", 1).cast("bigint")), F.struct(first.alias("first"), last.alias("last")))


def file_size(n):
    """Bytes with a unit of 1024 and at most two decimals."""
    level = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), level), 2)
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB"])), level + 1))
