"""Page layout: headers and footers, block types, geometry, tables, footnotes, contents pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lists
from marginalia.functions import text as X

PAGE_HEIGHT = 792.0


def band(y: Column, top: float = 0.0, height: float = PAGE_HEIGHT, share: float = 0.15) -> Column:
    return F.when(y < top + height * share, "header").when(y > top + height * (1 - share), "footer")


def running_lines(spans: DataFrame) -> DataFrame:
    """(pdf_filename, band, y_band, text, seen): texts in a header or footer band on 60 percent of the pages, and on two at least.

    spans: pdf_filename, page_number, y0, content. Occurrences count, not distinct pages.
    """
    pages = spans.groupBy("pdf_filename").agg(F.countDistinct("page_number").alias("pages")).filter("pages >= 2")
    near = spans.select("pdf_filename", band(F.col("y0")).alias("band"), (F.bround(F.col("y0") / 5.0) * 5).cast("bigint").alias("y_band"), X.stripped(F.col("content")).alias("raw")).filter("band is not null").filter(F.length("raw") >= 3)
    counts = near.withColumn("text", F.lower(X.squashed(F.col("raw")))).groupBy("pdf_filename", "band", "y_band", "text").agg(F.count(F.lit(1)).alias("seen"))
    return counts.join(pages, "pdf_filename").filter(F.col("seen") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6))).drop("pages")


def without_running_lines(spans: DataFrame, found: DataFrame, reach: float = 10.0) -> DataFrame:
    """Spans that equal no running line of their document within `reach` of its band."""
    f = found.select(F.col("pdf_filename").alias("p"), F.col("text").alias("t"), "y_band")
    test = (F.col("pdf_filename") == F.col("p")) & (F.lower(X.squashed(F.col("content"))) == F.col("t")) & (F.abs(F.col("y0") - F.col("y_band")) <= reach)
    return spans.join(f, test, "left_anti")


def is_heading(text: Column, font_size: Column | None = None, bold: Column | None = None, spans: Column | None = None) -> Column:
    """Short, no metadata, and either surely a heading or of five points by font, weight, length, case and spans."""
    n = F.size(X.words(text))
    font_size, bold, spans = font_size if font_size is not None else F.lit(12.0), bold if bold is not None else F.lit(False), spans if spans is not None else F.lit(1)
    points = [
        F.when(font_size >= 14, 2).otherwise(0), F.when(bold, 2).otherwise(0), (~text.endswith(".")).cast("int"), n.between(3, 10).cast("int"), (n >= 2).cast("int"),
        ((X.is_title(text) | X.is_upper(text)) & (F.length(text) > 10)).cast("int"), (spans <= 2).cast("int"),
    ]
    total = points[0]
    for p in points[1:]:
        total = total + p
    strong = X.matches(text, lists.HEADING_STRONG_CASED) | X.matches(text, lists.HEADING_STRONG, True)
    return (F.length(text) <= 100) & ~X.matches(text, lists.HEADING_NEGATIVE, True) & (strong | (total >= 5))


def is_list_item(text: Column) -> Column:
    return X.matches(text, lists.LIST_ITEM)


def block_type(text: Column) -> Column:
    """A heading is looked for first, so "1. Title" is one."""
    t = X.stripped(text)
    return F.when(is_heading(t), "heading").when(is_list_item(t), "list").otherwise("paragraph")


def reading_order(blocks: DataFrame) -> DataFrame:
    """The place of each block on its document's pages, top to bottom, then left to right."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("pdf_filename").orderBy("page_number", "y0", "x0", "ord")))


def toc_links(blocks: DataFrame, toc: DataFrame, offset: int = 0) -> DataFrame:
    """Each block with the latest entry on its page or before; of several on one page the least level, then the first.

    Where the latest page is the block's own, the last entry of an earlier page is a candidate too,
    and comes first among equal levels. Entries without a page count as on page 0.
    """
    page = F.when(F.col("page_number") > 0, F.col("page_number") + offset).otherwise(0)
    e = toc.select(F.col("pdf_filename").alias("p"), page.alias("toc_page"), "title", "level", "ord")
    # Candidates of each page that has entries: its own, and the last one before it.
    entries = e.groupBy("p", "toc_page").agg(F.min(F.struct("level", "ord", "title")).alias("best"), F.max(F.struct("ord", "level", "title")).alias("final"))
    before = F.lag("final").over(Window.partitionBy("p").orderBy("toc_page"))
    entries = entries.withColumn("earlier", before).withColumn("until", F.lead("toc_page").over(Window.partitionBy("p").orderBy("toc_page")))
    joined = blocks.join(entries, (F.col("pdf_filename") == F.col("p")) & (F.col("page_number") >= F.col("toc_page")) & (F.col("until").isNull() | (F.col("page_number") < F.col("until"))), "left")
    older = (F.col("toc_page") == F.col("page_number")) & F.col("earlier").isNotNull() & (F.col("earlier.level") <= F.col("best.level"))
    pick = lambda name: F.when(older, F.col(f"earlier.{name}")).otherwise(F.col(f"best.{name}"))
    return joined.select(*blocks.columns, pick("title").alias("toc_title"), pick("level").alias("toc_level"), "toc_page")


def is_toc_heading(block_kind: Column, content: Column, toc_title: Column) -> Column:
    return (block_kind == "heading") & (X.jaccard(content, toc_title) > 0.7)


def clean_grid(grid: Column) -> Column:
    """Rows padded to one width, cells squashed, empty rows and columns left out."""
    # A one-element array binds a value to a name, so that it is computed once.
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    cells = F.transform(grid, lambda r: F.transform(r, lambda c: X.squashed(F.coalesce(c, F.lit("")))))
    full = lambda rows: F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))

    def columns(rows: Column) -> Column:
        width = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
        used = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(rows, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
        return bound(used, lambda u: F.transform(rows, lambda r: F.transform(u, lambda i: F.coalesce(F.get(r, i), F.lit("")))))

    return bound(bound(cells, full), columns)


def markdown(grid: Column) -> Column:
    """A grid as a table with a rule below its first row."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---")))
    return F.when(F.size(grid) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(grid, F.lit(0))), rule), F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)), "\n"))


def grid_of_text(text: Column) -> Column:
    """Lines cut at two blanks or more."""
    return F.transform(F.filter(F.split(text, "\n"), lambda r: r.rlike(r"\S")), lambda r: F.split(X.stripped(r), r"\s{2,}"))


def column_gaps(spans: DataFrame, major: float = 50.0) -> DataFrame:
    """(pdf_filename, page_number, column_count, gaps): the gaps of more than `major` between neighbouring left edges of a page's spans."""
    edges = spans.select("pdf_filename", "page_number", "x0").distinct()
    steps = edges.withColumn("step", F.col("x0") - F.lag("x0").over(Window.partitionBy("pdf_filename", "page_number").orderBy("x0")))
    return steps.groupBy("pdf_filename", "page_number").agg((F.count_if(F.col("step") > major) + 1).alias("column_count"), F.sort_array(F.collect_list(F.when(F.col("step") > major, F.col("step")))).alias("gaps"))


def lines_of_spans(spans: DataFrame, reach: float = 5.0) -> DataFrame:
    """Spans of a page with the number of their line: a step down of more than `reach` from the span before begins one."""
    order = Window.partitionBy("pdf_filename", "page_number").orderBy("y0", "x0")
    new = F.coalesce((F.col("y0") - F.lag("y0").over(order) > reach).cast("int"), F.lit(0))
    return spans.withColumn("_new", new).withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def footnotes(spans: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """Small print in a page's lowest fifth: a number begins a note, later spans go on with it, those before the first are none."""
    low = spans.filter((F.col("y0") > height * 0.8) & (F.col("font_size") < 10)).withColumn("number", F.regexp_extract("content", r"^(\d+)\s", 1))
    order = Window.partitionBy("pdf_filename", "page_number").orderBy("y0", "x0")
    noted = low.withColumn("note", F.sum((F.col("number") != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("note > 0")
    rows = noted.groupBy("pdf_filename", "page_number", "note").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "content", "number"))).alias("s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return rows.select("pdf_filename", "page_number", F.col("s")[0]["number"].alias("reference_number"), F.array_join(F.col("s.content"), " ").alias("content"), "x0", "y0", "x1", "y1")


def let(value: Column, body) -> Column:
    """body(value), with the value made once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(items: Column, begins, full) -> Column:
    """An array of texts joined with blanks into longer ones: an item that `begins` one, given the item before it, or that follows
    a text so far that is `full`, starts a new one.

    The items are cut where that depends on two neighbours only, and each piece is folded for itself, so that the
    texts done, which a fold copies at each step, are those of one piece.
    """
    def step(state: Column, item: Column) -> Column:
        new = full(state["open"])
        done = F.when(new, F.array_append(state["done"], state["open"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(new, item).otherwise(F.concat_ws(" ", state["open"], item)).alias("open"))

    def fold(piece: Column) -> Column:
        first = F.struct(F.array().cast("array<string>").alias("done"), F.get(piece, F.lit(0)).alias("open"))
        return F.aggregate(F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(0))), first, step, lambda state: F.array_append(state["done"], state["open"]))

    def whole(x: Column) -> Column:
        n, at = F.size(x), lambda k: F.element_at(x, k.cast("int"))
        starts = F.filter(F.sequence(F.lit(1), n), lambda k: F.when(k == 1, True).otherwise(begins(at(k), at(k - 1))))
        pieces = let(starts, lambda s: F.transform(s, lambda b, k: F.slice(x, b, F.coalesce(F.get(s, k + 1), n + 1) - b)))
        return F.when(n > 0, F.flatten(F.transform(pieces, fold))).otherwise(F.array().cast("array<string>"))

    return let(items, whole)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a page's text; none of a null or blank one.

    Two parts or more between empty lines are paragraphs, those that are long enough, or not so long with a full stop. Where there
    are none, lines are joined: a capital after a full stop begins a paragraph, and so does what follows 800 characters. Of
    those of more than 20 characters, each of less than 100 goes on with the one before while that has less than 400.
    """
    parted = lambda by: F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), X.stripped), lambda p: p != "")

    def by_lines() -> Column:
        joined = runs(parted("\n"), lambda line, before: F.endswith(before, F.lit(".")) & line.rlike(r"^\p{Lu}"), lambda open_: F.length(open_) > 800)
        return runs(F.filter(joined, lambda p: F.length(p) > 20), lambda p, _: F.length(p) >= 100, lambda open_: F.length(open_) >= 400)

    long_enough = lambda p: (F.length(p) > 50) | ((F.length(p) > 20) & F.contains(p, F.lit(".")))
    good = let(parted("\n\n"), lambda blocks: F.when(F.size(blocks) >= 2, F.filter(blocks, long_enough)))
    return let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(by_lines()))


def paragraph_positions(pages: DataFrame) -> DataFrame:
    """The paragraphs of each page's text (`content`), at even steps down the page; a page without any gives no rows."""
    parts = pages.select("pdf_filename", "page_number", paragraphs(F.col("content")).alias("parts"))
    step = F.when(F.size("parts") > 1, F.lit(648.0) / F.size("parts")).otherwise(324.0)
    return parts.select("pdf_filename", "page_number", step.alias("step"), F.posexplode("parts").alias("paragraph_index", "text")).select("pdf_filename", "page_number", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), "text", F.round(F.lit(72.0) + F.col("paragraph_index") * F.col("step"), 6).alias("y0"))


def toc_page_signals(text: Column) -> Column:
    """How many signs of a contents page a page's text has, of the ten; `contents` alone is ten."""
    t = F.regexp_replace(F.lower(text), r"[ \t]", "")
    # The signs of a contents page.
    signs = [t.rlike(r"[\p{L}\p{N}_]\.{2,}\d"), F.size(F.filter(F.regexp_extract_all(t, F.lit(X.TOKEN), F.lit(0)), lambda w: w.rlike(r"^\d{1,3}$"))) > 5, t.rlike(r"\d\.\d"), F.contains(t, F.lit("appendix")), t.rlike(r"\d\."), F.contains(t, F.lit("acknowledgements")), F.contains(t, F.lit("bibliography")), F.contains(t, F.lit("references"))]
    total = signs[0].cast("int")
    for s in signs[1:]:
        total = total + s.cast("int")
    return F.when(F.contains(t, F.lit("contents")), 10).otherwise(total)


def element_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"))


def worth_analysing(figures: DataFrame, page_area: float = 612.0 * PAGE_HEIGHT, share: float = 0.15, most: int = 20) -> DataFrame:
    """Figures that cover enough of their page, the first `most` of each document."""
    large = figures.withColumn("area_share", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / page_area, 6)).filter(F.col("area_share") >= share)
    return large.withColumn("place", F.row_number().over(Window.partitionBy("pdf_filename").orderBy("page_number", "box_id"))).filter(F.col("place") <= most)


def continues_toc(text: Column) -> Column:
    """Two signs of a contents page's continuation or more."""
    t = F.regexp_replace(F.lower(text), r"[ \t]", "")
    numbers = F.size(F.filter(F.regexp_extract_all(t, F.lit(X.TOKEN), F.lit(0)), lambda w: w.rlike(r"^\d{1,3}$")))
    # The signs of its continuation.
    signs = [F.contains(t, F.lit("appendix")), t.rlike(r"[\p{L}\p{N}_]\.{2,}\d"), numbers > 3, X.holds(t, ["acknowledgements", "bibliography", "references", "notes", "abouttheauthor"]), t.rlike(r"\d:")]
    total = signs[0].cast("int")
    for s in signs[1:]:
        total = total + s.cast("int")
    return total >= 2
