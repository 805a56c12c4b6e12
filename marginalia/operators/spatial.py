"""Joins of boxes on a page by grid cells, and tables rebuilt from positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources import shared

PAGE = ["pdf_filename", "page_number"]
#: Side of a grid cell.
CELL = 64.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def grown(b: Column, x: float, y: float | None = None) -> Column:
    y = x if y is None else y
    return box(b["x0"] - x, b["y0"] - y, b["x1"] + x, b["y1"] + y)


def meeting(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """Rows of both sides whose boxes meet on one page, borders included; the columns of `left` (with `area`) and of `right` (with `spot`).

    Boxes are joined where they share a grid cell. A pair that shares several counts in one of them only, the cell of the lower
    corner of what both cover, so none is found twice and nothing is sorted out afterwards. Boxes with a null side, or turned
    inside out, meet nothing.
    """
    at = lambda v: F.floor(v / cell)

    def dealt(df: DataFrame, b: str) -> DataFrame:
        known = df.filter((F.col(b)["x0"] <= F.col(b)["x1"]) & (F.col(b)["y0"] <= F.col(b)["y1"]))
        across = known.withColumn("_cx", F.explode(F.sequence(at(F.col(b)["x0"]), at(F.col(b)["x1"]))))
        return across.withColumn("_cy", F.explode(F.sequence(at(F.col(b)["y0"]), at(F.col(b)["y1"]))))

    a, s = F.col("area"), F.col("spot")
    both = dealt(left, "area").join(dealt(right, "spot"), [*PAGE, "_cx", "_cy"])
    meet = (a["x0"] <= s["x1"]) & (a["x1"] >= s["x0"]) & (a["y0"] <= s["y1"]) & (a["y1"] >= s["y0"])
    here = (F.col("_cx") == at(F.greatest(a["x0"], s["x0"]))) & (F.col("_cy") == at(F.greatest(a["y0"], s["y0"])))
    return both.filter(meet & here).drop("_cx", "_cy")


def close(a: Column, b: Column, reach: float) -> Column:
    """Whether boxes meet, or have sides within `reach` of each other both across and down."""
    meet = (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])
    gap = lambda p, q: F.least(F.abs(a[p] - b[q]), F.abs(a[q] - b[p]), F.abs(a[p] - b[p]), F.abs(a[q] - b[q]))
    return meet | ((gap("x0", "x1") <= reach) & (gap("y0", "y1") <= reach))


def link_targets(entries: DataFrame, links: DataFrame, reach: float = 10.0, first: int = 64, step: int = 8) -> DataFrame:
    """Each contents entry (pdf_filename, page_number, entry_id, bbox) with the first link (pdf_filename, page_number, ord, bbox, dest_page)
    whose box meets its own or is close: pdf_filename, entry_id, ord, dest_page. Entries without such a link give no rows.

    Entries meet a page's links in turns, in order: the `first` ones, then `step` times as many in each, and leave once found, so that pairs don't grow
    with the square of a page's boxes.
    """
    spark, found = entries.sparkSession, []
    folder = shared.scratch(spark, "links")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord", "dest_page"))
    spots = kept(links.select(*PAGE, "ord", "dest_page", F.col("bbox").alias("spot"), place.alias("place")), "spots")
    # Boxes with sides within reach of each other meet once one is grown by reach.
    left = kept(entries.select(*PAGE, "entry_id", F.col("bbox").alias("own"), grown(F.col("bbox"), reach).alias("area")), "entries")
    low, high, last = 0, first, spots.agg(F.max("place")).head()[0] or 0
    while not found or (low < last and not left.isEmpty()):
        near = meeting(left, spots.filter((F.col("place") > low) & (F.col("place") <= high)).drop("place")).filter(close(F.col("own"), F.col("spot"), reach))
        got = kept(near.groupBy(*PAGE, "entry_id").agg(F.min(F.struct("ord", "dest_page")).alias("x")), f"got_{low}")
        found.append(got)
        left = kept(left.join(got, [*PAGE, "entry_id"], "left_anti"), f"left_{low}")
        low, high = high, high * step
    every = reduce(DataFrame.union, found)
    return every.groupBy("pdf_filename", "entry_id").agg(F.min("x").alias("x")).select("pdf_filename", "entry_id", "x.ord", "x.dest_page")


def highest(areas: DataFrame, spots: DataFrame, by: list[str], own: list[str]) -> DataFrame:
    """For each area (by, own, x0, y0, x1, y1) the spot (by, x, y) in it that has the least y, then the least x, borders included: by, own, y, x.

    Areas without a spot give no rows, nor do those with a null side, or turned inside out. Areas don't meet spots one by one: all abscissas of a page
    are numbered, an area's range of them is cut into at most two spans of each power of two, and each span's spots and areas are passed
    once from below, where an area takes the last spot before it. So an area costs the logarithm of the page's spots, however many it holds.
    """
    c, lit = F.col, F.lit
    known = lambda df, names: df.filter(" and ".join(f"{n} is not null" for n in names))
    areas = known(areas, [*by, "x0", "y0", "x1", "y1"]).filter("x0 <= x1 and y0 <= y1").select(*by, *own, "x0", "y0", "x1", "y1")
    spots = known(spots, [*by, "x", "y"]).select(*by, "x", "y")
    xs = spots.select(*by, "x").union(areas.select(*by, "x0")).union(areas.select(*by, "x1")).distinct()
    xs = xs.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("x")).cast("bigint") - 1).withColumn("top", F.count(lit(1)).over(Window.partitionBy(*by)))
    # A page of n abscissas has levels up to the length of n in bits.
    levels = F.sequence(lit(0), F.length(F.bin("top")))
    power = lambda level: F.pow(lit(2.0), level).cast("bigint")
    first = lambda level: F.floor((c("low") + power(level) - 1) / power(level))
    last = lambda level: F.floor((c("high") + 1) / power(level)) - 1
    node = lambda level, k: F.struct(level.alias("level"), k.alias("k"))

    def outer(level: Column) -> Column:
        """The spans of a level that are in the range, but not in one of the level above that is."""
        ends = F.array_distinct(F.array(first(level), last(level)))
        inside = lambda k: (first(level + 1) <= F.floor(k / 2)) & (F.floor(k / 2) <= last(level + 1))
        return F.when(first(level) <= last(level), F.transform(F.filter(ends, lambda k: ~inside(k)), lambda k: node(level, k))).otherwise(F.array().cast("array<struct<level:int,k:bigint>>"))

    low = xs.select(*by, c("x").alias("x0"), c("at").alias("low"), "top")
    high = xs.select(*by, c("x").alias("x1"), c("at").alias("high"))
    dealt = areas.join(low, [*by, "x0"]).join(high, [*by, "x1"]).select(*by, *own, "y0", "y1", F.explode(F.flatten(F.transform(levels, outer))).alias("node"))
    held = spots.join(xs, [*by, "x"]).select(*by, "x", "y", F.explode(F.transform(levels, lambda level: node(level, F.floor(c("at") / power(level))))).alias("node"))
    key = [*by, "node"]
    asked = dealt.select(*key).distinct()
    held = held.join(asked, key, "left_semi").groupBy(*key, "y").agg(F.min("x").alias("x"))
    empty = [lit(None).cast(dealt.schema[n].dataType).alias(n) for n in [*own, "y1"]]
    both = dealt.select(*key, *own, "y1", c("y0").alias("y"), lit(None).cast("double").alias("x"), lit(1).alias("kind")).unionByName(held.select(*key, *empty, "y", "x", lit(0).alias("kind")))
    upwards = Window.partitionBy(*key).orderBy(c("y").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    spot = F.last(F.when(c("kind") == 0, F.struct("y", "x")), ignorenulls=True).over(upwards)
    best = both.withColumn("spot", spot).filter("kind = 1 and spot.y <= y1").groupBy(*by, *own).agg(F.min("spot").alias("spot"))
    return best.select(*by, *own, "spot.y", "spot.x")


def captions(boxes: DataFrame, spans: DataFrame, reach: float = 50.0, margin: float = 30.0) -> DataFrame:
    """Each box (pdf_filename, page_number, box_id, x0, y0, x1, y1) with its caption: of the spans that begin below it, or above it
    where `kind` is table, the first that begins as a caption does, else the first short one. Boxes without a column `kind` are figures; null without a span.

    Spans that begin at the same spot are one before they meet boxes, the least text of each rank; texts join the boxes when their spots are found.
    """
    boxes = boxes if "kind" in boxes.columns else boxes.withColumn("kind", F.lit("figure"))
    c, above = F.col, F.col("kind") == "table"
    area = box(c("x0") - margin, F.when(above, c("y0") - reach).otherwise(c("y1")), c("x1") + margin, F.when(above, c("y0")).otherwise(c("y1") + reach))
    rank = F.when(c("content").rlike(r"(?i)^\s*(figure|fig\.?|table|tab\.?|chart|diagram)\s*\d+"), 1).when(F.length("content") < 200, 2)
    ranked = spans.select(*PAGE, rank.alias("rank"), c("x0").cast("double").alias("x"), c("y0").cast("double").alias("y"), "content").filter("rank is not null")
    spots = ranked.groupBy(*PAGE, "rank", "y", "x").agg(F.min("content").alias("caption"))
    areas = boxes.select(*PAGE, "box_id", area.alias("area"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).select(*PAGE, "rank", "box_id", "area.*")
    met = highest(areas, spots, [*PAGE, "rank"], ["box_id"])
    best = met.groupBy(*PAGE, "box_id").agg(F.min(F.struct("rank", "y", "x")).alias("s")).select(*PAGE, "box_id", "s.*").join(spots, [*PAGE, "rank", "y", "x"]).select(*PAGE, "box_id", "caption")
    return boxes.select(*PAGE, "box_id").distinct().join(best, [*PAGE, "box_id"], "left")


def numbered_spans(spans: DataFrame, down: float, across: float) -> DataFrame:
    """The spans (x0, y0, x1, content) of each region (pdf_filename, page_number, region) with their row and column, 1-based.

    Rows are islands of spans, from the top, whose upper edges are at most `down` below each other's. In a row, from the left, a span that
    begins more than `across` beyond the right edge of the one before begins a cell; the others go on with it, after a blank. Blank spans
    don't count; a region without others gives no rows.
    """
    region = [*PAGE, "region"]
    s = spans.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).filter("content <> ''")
    # The region leads the keys of sorts, as it tells more rows apart than its document.
    from_top = Window.partitionBy(*region[::-1]).orderBy("y0", "x0", "x1", "content")
    steps = s.withColumn("_new", F.coalesce((F.col("y0") - F.lag("y0").over(from_top) > down).cast("int"), F.lit(1)))
    rows = steps.withColumn("row", F.sum("_new").over(from_top.rowsBetween(Window.unboundedPreceding, 0)))
    from_left = Window.partitionBy(*region[::-1], "row").orderBy("x0", "y0", "x1", "content")
    gaps = rows.withColumn("_new", F.coalesce((F.col("x0") - F.lag("x1").over(from_left) > across).cast("int"), F.lit(1)))
    return gaps.withColumn("column", F.sum("_new").over(from_left.rowsBetween(Window.unboundedPreceding, 0)))


def table_cells(spans: DataFrame, down: float = 5.0, across: float = 20.0) -> DataFrame:
    """The cells (pdf_filename, page_number, region, row, column, content) that `numbered_spans` tells apart, and empty ones at the end of
    rows that have fewer than the widest."""
    region = [*PAGE, "region"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "content"))), lambda x: x["content"])
    cells = numbered_spans(spans, down, across).groupBy(*region, "row", "column").agg(F.array_join(ordered, " ").alias("content"))
    wide = cells.groupBy(*region, "row").agg(F.max("column").alias("own")).withColumn("most", F.max("own").over(Window.partitionBy(*region)))
    empty = wide.filter("own < most").select(*region, "row", F.explode(F.sequence(F.col("own") + 1, F.col("most"))).alias("column"), F.lit("").alias("content"))
    return cells.unionByName(empty)


def table_grids(spans: DataFrame, down: float = 5.0, across: float = 20.0) -> DataFrame:
    """(pdf_filename, page_number, region, grid): the cells of each region as rows of text, for `layout.cleaned` and `layout.markdown`.

    Rows with fewer cells than the widest get empty ones when a region's rows are together, so that spans are passed once."""
    region = [*PAGE, "region"]
    # A row's spans are collected once; its cells are the stretches of one column.
    rows = numbered_spans(spans, down, across).groupBy(*region, "row").agg(F.array_sort(F.collect_list(F.struct("column", "x0", "y0", "x1", "content"))).alias("l"))
    opens = F.filter(F.transform("l", lambda x, i: F.when((i == 0) | (x["column"] != F.get("l", i - 1)["column"]), i)), lambda i: i.isNotNull())
    stretch = lambda i, k: F.slice("l", i + 1, F.coalesce(F.get("opens", k + 1), F.size("l")) - i)
    cells = F.transform("opens", lambda i, k: F.array_join(F.transform(stretch(i, k), lambda x: x["content"]), " "))
    rows = rows.withColumn("opens", opens).select(*region, "row", cells.alias("cells"))
    grids = rows.groupBy(*region).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("grid"), F.max(F.size("cells")).alias("most"))
    return grids.select(*region, F.transform("grid", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("most") - F.size(r)))).alias("grid"))
