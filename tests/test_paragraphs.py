"""Paragraphs of spans against a plain loop over pages, one line after the other."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marginalia.operators import layout, paragraphs

SPANS = "pdf_filename string, page_number int, ord int, content string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, font_weight string"
TEXTS = ["The house on the hill is old.", "and it has a door", "1. First point of several, which is long", "Note: see below for more of the same here", "• bullet", "* star", "ii. roman", "A Large And Titled Line", "12 small note", "short", "", "  ", None, "'s own", "Ends with the", "What now? Élan and more words in this line.", "Élan vital of the long line that follows here"]


def span_rows(pages=30, seed=5):
    rng, rows = random.Random(seed), []
    for p in range(pages):
        for k in range(rng.choice([0, 1, 2, 12, 30])):
            x0, y0 = rng.choice([50.0, 52.0, 300.0, 331.0, 420.0]), rng.choice([72.0, 75.0, 84.0, 90.0, 110.0, 130.0, 600.0, 640.0])
            row = ("d" if p % 2 else None, p, k, rng.choice(TEXTS), x0, y0, x0 + 90, y0 + rng.choice([8.0, 10.0]), rng.choice(["F", "G", None]), rng.choice([8.0, 9.0, 12.0, 16.0, None]), rng.choice(["bold", "normal", None]))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


def loop_over(page):
    """(note, text, x0, y0, x1, y1, font, mean size, bold, lines, spans) of one page's spans."""
    spans = [dict(zip("p n ord t x0 y0 x1 y1 font size weight".split(), r)) for r in page]
    for s in spans:
        s["t"], s["size"] = s["t"] or "", 12.0 if s["size"] is None else s["size"]
    bottom, top = max(s["y1"] for s in spans), min(s["y0"] for s in spans)
    deep = [s for s in spans if s["y0"] > bottom - (bottom - top) * 0.2]
    noted = [s for s in deep if s["size"] < 10 and (len(deep) > 1 or re.match(r"\d+[\s.]|[*†‡]", s["t"].strip()))]
    plain = [s for s in spans if not any(s is n for n in noted)]
    edges = sorted(s["x0"] for s in plain)
    walls = [(a + b) / 2 for a, b in zip(edges, edges[1:]) if b - a > 30 and sum(x > (a + b) / 2 for x in edges) > 3]
    columns = [(False, [s for s in plain if sum(s["x0"] > w for w in walls) == k]) for k in range(len(walls) + 1)] + [(True, noted)]
    out = []
    for note, column in columns:
        lines, last = [], None
        for s in sorted(column, key=lambda s: (s["y0"], s["x0"], s["ord"])):
            if last is None or s["y0"] - last > 5:
                lines.append([])
            lines[-1].append(s)
            last = s["y0"]
        open_, text, low, made = [], "", None, []
        for line in lines:
            words = " ".join(s["t"] for s in line).strip()
            if not words:
                continue
            starts = (words[0].isupper() and len(words) > 20) or re.match(r"\d+\.|[A-Z][a-z]+:|[•\-*]", words)
            goes_on = not text.endswith((".", "!", "?", ":", ";")) or not re.match("[A-Z]", words) or (len(words.split()) <= 8 and len(words) < 50)
            mark = re.match(r"\d+[\s.]|[*†‡§¶]|[ivxlcdmIVXLCDM]+[\s.]", words)
            if low is None or min(s["y0"] for s in line) - low > 15 or (starts and not goes_on) or mark:
                made.append([])
            made[-1].append((words, line))
            text, low = words, max(s["y1"] for s in line)
        for one in made:
            whole, own = " ".join(w for w, _ in one), [s for _, line in one for s in line]
            if len(whole) >= 3:
                out.append((note, whole, min(s["x0"] for s in own), min(s["y0"] for s in own), max(s["x1"] for s in own), max(s["y1"] for s in own), Counter(s["font"] for s in own).most_common(1)[0][0], round(sum(s["size"] for s in own) / len(own), 6), any(s["weight"] == "bold" for s in own), len(one), len(own)))
    return out


def test_as_a_loop_over_lines(spark):
    rows = span_rows()
    found = paragraphs.span_paragraphs(spark.createDataFrame(rows, SPANS)).collect()
    for p in {r[1] for r in rows}:
        got = sorted((r for r in found if r.page_number == p), key=lambda r: r.place)
        want = loop_over([r for r in rows if r[1] == p])
        assert [r.place for r in got] == list(range(1, len(want) + 1))
        assert [(r.block_type == "footnote", r.content, r.x0, r.y0, r.x1, r.y1, r.font_name, round(r.font_size, 6), r.has_bold, r.line_count, r.span_count) for r in got] == want
    kinds = Counter(r.block_type for r in found)
    assert kinds["footnote"] and kinds["heading"] and kinds["paragraph"]


def test_one_shuffle_by_page(spark):
    spans = spark.createDataFrame(span_rows(3), SPANS)
    plan = paragraphs.span_paragraphs(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_spans_and_no_boxes(spark):
    assert paragraphs.span_paragraphs(spark.createDataFrame([], SPANS)).count() == 0
    bare = [("d", 1, 1, "text without a place", None, 1.0, 2.0, 3.0, "F", 12.0, None)]
    assert paragraphs.span_paragraphs(spark.createDataFrame(bare, SPANS)).count() == 0


def test_continuation_by_every_sign(spark):
    """What the rules say sign by sign is what the shorter test says."""
    pairs = [(a.strip(), b.strip()) for a in TEXTS if a and a.strip() for b in TEXTS if b and b.strip()]
    ends = (",", " and", " or", " but", " the", " a", " an", " of", " in", " to", " for", " with")
    heads = ("'", "and ", "or ", "but ", "so ", "however", "therefore", "thus")
    want = [not a.endswith((".", "!", "?", ":", ";")) or a.endswith(ends) or b.startswith(heads) or b[0].islower() or not re.match("[A-Z]", b) or (len(b.split()) <= 8 and len(b) < 50) for a, b in pairs]
    got = spark.createDataFrame(pairs, "a string, b string").select(paragraphs.continues(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == want


def test_first_of_equally_frequent(spark):
    d = spark.createDataFrame([(["b", "a", "a", "b"],), ([None, "a", None],), (["c"],)], "v array<string>")
    assert [r.m for r in d.select(paragraphs.first_mode(F.col("v")).alias("m")).collect()] == ["b", None, "c"]


def test_lines_agree_with_span_lines(spark):
    """A page of one column has the lines that the plain line rule gives."""
    rows = [("d", 1, k, f"w{k}", 50.0, float(k * 7 % 40), 60.0, k * 7 % 40 + 5.0, "F", 12.0, None) for k in range(20)]
    spans = spark.createDataFrame(rows, SPANS)
    plain = layout.lines_of_spans(spans).select("line").distinct().count()
    lines = paragraphs.lines_of(paragraphs.in_parts(spans.withColumn("bold", F.lit(False)).withColumn("font_size", F.lit(12.0))))
    assert lines.count() == plain
