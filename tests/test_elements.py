"""Blocks of four kinds of elements against a plain loop over the pages."""

import random

from marginalia.operators import elements

BASE = "pdf_filename string, page_number int, ord int, "
BOX = "x0 double, y0 double, x1 double, y1 double, "
SCHEMAS = {
    "paragraphs": BASE + "content string, y0 double, other int",
    "tables": BASE + BOX + "markdown string, grid array<array<string>>, caption string",
    "figures": BASE + BOX + "caption string, image_type string",
    "footnotes": BASE + BOX + "content string, reference_number string",
}
TOC = "pdf_filename string, page_number int, title string, level int, ord int"


def made(seed):
    rng = random.Random(seed)
    base = lambda: (rng.choice(["a", "b", None]), rng.randrange(1, 6), rng.randrange(3))
    box = lambda: (rng.choice([10.0, 50.0]), float(rng.randrange(5)), 60.0, 90.0)
    some = lambda make: [make() for _ in range(40)]
    rows = {
        "paragraphs": some(lambda: base() + (rng.choice(["1. Introduction", "- one of these", "x", "", None, "long text " * 5000]), rng.choice([None, 1.0, 3.0]), 1)),
        "tables": some(lambda: base() + box() + (rng.choice([None, "", "| m |"]), rng.choice([None, [], [["a", None], ["b"]]]), rng.choice([None, "c"]))),
        "figures": some(lambda: base() + box() + (rng.choice([None, "Figure 1"]), rng.choice([None, "png"]))),
        "footnotes": some(lambda: base() + box() + (rng.choice([None, "note"]), "1")),
    }
    return {k: v + v[:4] for k, v in rows.items()}


def test_order_and_contents(spark):
    rows = made(3)
    toc = spark.createDataFrame([("a", 2, "Introduction", 1, 0)], TOC)
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    found = elements.content_blocks(**frames, toc=toc).collect()
    wanted = []
    for kind, name in enumerate(SCHEMAS):
        for r in rows[name]:
            pdf, page, ord_ = r[:3]
            if kind == 0:
                text = r[3] or ""
                type_ = "paragraph" if len(text.strip()) < 3 else "heading" if text.startswith("1.") else "list" if text.startswith("-") else "paragraph"
                wanted.append((pdf, page, r[4] or 0.0, 50.0, kind, ord_, type_, text))
            else:
                if kind == 1:
                    text = r[7] or "\n".join(" | ".join(c or "" for c in row) for row in r[8] or [])
                else:
                    text = r[7]
                wanted.append((pdf, page, r[4], r[3], kind, ord_, ["table", "figure", "footnote"][kind - 1], text))
    for pdf in ("a", "b", None):
        order = sorted((w for w in wanted if w[0] == pdf), key=lambda w: w[1:6])
        mine = sorted((r for r in found if r.pdf_filename == pdf), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(order) + 1))
        assert [(r.page_number, r.y0, r.x0, r.block_type) for r in mine] == [w[1:4] + (w[6],) for w in order]
        # Elements that agree in all that orders them may be in either order.
        assert sorted((w[1:6], w[7] or "") for w in order) == sorted((w[1:6], r.content or "") for w, r in zip(order, mine))
        assert all((r.toc_title is not None) == (pdf == "a" and r.page_number >= 2) for r in mine)
    heads = [r for r in found if r.is_toc_heading]
    assert all(r.block_type == "heading" for r in heads)
    assert {(r.row_count, r.column_count) for r in found if r.block_type == "table"} == {(0, 0), (2, 2)}


def test_empty_tables_and_described_figures(spark):
    none = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    toc = spark.createDataFrame([], TOC)
    assert elements.content_blocks(**none, toc=toc).count() == 0
    figures = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 9.0, 4.0, None, None), ("a", 1, 1, 0.0, 5.0, 9.0, 9.0, "Figure 1", "png")], SCHEMAS["figures"])
    assert [r.content for r in elements.figure_blocks(figures, True).orderBy("ord").collect()] == ["[Figure: unknown image]", "Figure 1"]
    found = elements.content_blocks(**(none | {"figures": figures}), toc=toc).orderBy("place").collect()
    assert [(r.content, r.width, r.height, r.toc_title) for r in found] == [(None, 9.0, 4.0, None), ("Figure 1", 9.0, 4.0, None)]
