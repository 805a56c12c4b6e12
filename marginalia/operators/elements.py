"""Paragraphs, tables, figures and footnotes as one ordered stream of blocks, with their contents entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import layout

#: Left and right edge, and height, of a paragraph whose place on the page is an estimate.
PARAGRAPH_BOX = (50.0, 550.0, 50.0)
#: The columns of every block; those that a kind of element lacks are null.
BLOCK = {
    "pdf_filename": "string", "page_number": "bigint", "kind": "int", "ord": "bigint", "block_type": "string", "content": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double",
    "caption": "string", "row_count": "bigint", "column_count": "bigint", "image_type": "string", "reference_number": "string",
}


def _as_blocks(elements: DataFrame, kind: int, **own) -> DataFrame:
    """`own` columns first, then those of the elements, then nulls; kinds are in the order in which equal places are read."""
    made = {"kind": F.lit(kind)} | own
    pick = lambda c: made[c] if c in made else F.col(c) if c in elements.columns else F.lit(None)
    return elements.select(*(pick(c).cast(t).alias(c) for c, t in BLOCK.items()))


def paragraph_blocks(paragraphs: DataFrame) -> DataFrame:
    """(pdf_filename, page_number, ord, content, y0): a heading, a list or a paragraph in a box of fixed width. Null, empty and
    very short texts are paragraphs; a null y0 is the page's top."""
    left, right, height = PARAGRAPH_BOX
    y0 = F.coalesce("y0", F.lit(0.0))
    short = F.length(X.stripped(F.coalesce("content", F.lit("")))) < 3
    kind = F.when(short, "paragraph").otherwise(layout.block_type(F.col("content")))
    return _as_blocks(paragraphs, 0, block_type=kind, content=F.coalesce("content", F.lit("")), x0=F.lit(left), x1=F.lit(right), y0=y0, y1=y0 + height)


def table_blocks(tables: DataFrame) -> DataFrame:
    """(.., box, markdown, grid, caption): the table's markdown, or without one its cells with bars between. A null or empty grid
    has no rows and columns; columns are those of the first row."""
    grid = F.coalesce("grid", F.expr("cast(array() AS array<array<string>>)"))
    cells = F.array_join(F.transform(grid, lambda r: F.array_join(r, " | ", "")), "\n")
    given = F.coalesce("markdown", F.lit(""))
    return _as_blocks(tables, 1, block_type=F.lit("table"), content=F.when(given != "", given).otherwise(cells), row_count=F.size(grid), column_count=F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0)))


def figure_blocks(figures: DataFrame, described: bool = False) -> DataFrame:
    """(.., box, caption, image_type): the caption, which may be null; `described`: a figure without one says what it is."""
    says = F.concat(F.lit("[Figure: "), F.coalesce("image_type", F.lit("unknown")), F.lit(" image]"))
    return _as_blocks(figures, 2, block_type=F.lit("figure"), content=F.coalesce("caption", says) if described else F.col("caption"))


def footnote_blocks(footnotes: DataFrame) -> DataFrame:
    """(.., box, content, reference_number)"""
    return _as_blocks(footnotes, 3, block_type=F.lit("footnote"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """`place` counts a document's blocks from 1, by page, then from top to bottom and left to right; equal places by kind, then
    `ord`. Blocks are ranked page by page and only the pages' sizes document by document, so a long document isn't one task."""
    own = [F.col("pdf_filename"), F.col("page_number")]
    ranked = blocks.withColumn("_rank", F.row_number().over(Window.partitionBy(*own).orderBy("y0", "x0", "kind", "ord")))
    earlier = F.sum("n").over(Window.partitionBy("pdf_filename").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    before = blocks.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(F.col("pdf_filename").alias("_pdf"), F.col("page_number").alias("_page"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = F.col("pdf_filename").eqNullSafe(F.col("_pdf")) & F.col("page_number").eqNullSafe(F.col("_page"))
    return ranked.join(before, same).withColumn("place", (F.col("_before") + F.col("_rank")).cast("bigint")).drop("_rank", "_before", "_pdf", "_page")


def content_blocks(paragraphs: DataFrame, tables: DataFrame, figures: DataFrame, footnotes: DataFrame, toc: DataFrame, offset: int = 0) -> DataFrame:
    """The second stage: all elements of all documents as ordered blocks with their contents entries.

    Any of the tables may be empty; blocks of a document without entries, or before its first one, have a null entry and are no heading of one. Entries'
    pages count from `offset`. Rows that repeat are blocks of their own. Columns beyond those named are left out.
    """
    blocks = paragraph_blocks(paragraphs)
    for more in (table_blocks(tables), figure_blocks(figures), footnote_blocks(footnotes)):
        blocks = blocks.unionByName(more)
    linked = layout.toc_links(in_reading_order(blocks), toc, offset)
    box = {"width": F.when(F.col("block_type") == "figure", F.col("x1") - F.col("x0")), "height": F.when(F.col("block_type") == "figure", F.col("y1") - F.col("y0"))}
    heading = F.coalesce(layout.is_toc_heading(F.col("block_type"), F.col("content"), F.col("toc_title")), F.lit(False))
    return linked.withColumns(box | {"is_toc_heading": heading}).drop("kind", "ord")
