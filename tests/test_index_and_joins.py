"""The stored index, the containment join and the spatial joins against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import bm25index, layout, matching, pagesearch, retrieval, spatial

CHUNKS = "collection string, pdf_filename string, chunk_id string, content string"


def chunk_rows(documents, words=12, seed=1):
    rng = random.Random(seed)
    return [(c, d, f"{c}-{d}-{k}", " ".join(rng.choices([*"the a of red green blue one two tree house".split(), *"bcdefghijklmnopqrstuvwxyz"], k=rng.randrange(words)))) for c, d in documents for k in range(5)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "red tree tree"), (2, "the house of"), (3, ""), (4, "unheard")], "query_id bigint, query string")


def test_stored_index_is_bm25_after_changes(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(bm25index, "BUCKETS", 8)
    index = bm25index.StoredBm25(spark, str(tmp_path / "index"))
    assert index.search(asked, 5).count() == 0 and index.last() == 0
    documents = [("x", "a"), ("x", "b"), ("y", "a"), (None, "c")]
    state = chunk_rows(documents)
    index.upsert(spark.createDataFrame(state, CHUNKS))

    def same():
        alive = spark.createDataFrame([r for r in state if r[3].strip()], CHUNKS)
        want = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in retrieval.bm25(alive, asked, 5).collect()}
        assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in index.search(asked, 5).collect()} == want and want

    same()
    fresh = chunk_rows([("x", "b"), ("z", "new")], 30, 2)
    state = [r for r in state if r[:2] != ("x", "b")] + fresh
    index.upsert(spark.createDataFrame(fresh, CHUNKS))
    same()
    state = [r for r in state if r[:2] not in ((None, "c"), ("x", "a"))]
    index.delete(spark.createDataFrame([(None, "c"), ("x", "a"), ("no", "such")], "collection string, pdf_filename string"))
    same()
    # A generation that ended before its commit is not seen, and the next one writes over it.
    with monkeypatch.context() as m:
        write = index.write

        def broken(name, *rest):
            if name == "commits":
                raise OSError("lost")
            write(name, *rest)

        m.setattr(index, "write", broken)
        with pytest.raises(OSError):
            index.upsert(spark.createDataFrame(chunk_rows([("y", "a"), ("lost", "d")], 30, 3), CHUNKS))
    same()
    fresh = chunk_rows([("y", "a")], 30, 4)
    state = [r for r in state if r[:2] != ("y", "a")] + fresh
    index.upsert(spark.createDataFrame(fresh, CHUNKS))
    same()
    plan = plan_of(index.search(asked, 5))
    assert "bucket" in plan[plan.index("PartitionFilters") :][:300] and "CartesianProduct" not in plan and "NestedLoop" not in plan
    index = index.compacted(str(tmp_path / "compact"))
    assert index.last() == 1
    same()
    index.delete(spark.createDataFrame([r[:2] for r in state], "collection string, pdf_filename string"))
    assert index.search(asked, 5).count() == 0


def shown(title, spans):
    """(place, rule) by trying every span in turn for each rule."""
    title = (title or "").lower().strip()
    words = title.split()
    held = lambda ws, s: sum(w in s.lower() for w in ws)
    keys = [w for w in words[:3] if len(w) > 3]
    rules = [lambda s: title in s.lower(), lambda s: len(words) > 1 and held(words, s) >= len(words) // 2, lambda s: len(words) > 2 and keys and held(keys, s) == len(keys)]
    return next(((place, k + 1) for k, rule in enumerate(rules) for place, s in spans if s and rule(s)), None)


def test_title_spans_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    parts = ["art", "party", "of", "a", "Results", "intro", "introduction", "method", "x", "Ähre", "data"]
    spans = [("d", k, rng.choice(["", " ".join(rng.choices(parts, k=rng.randrange(1, 5)))])) for k in range(60)] + [("e", 1, None), ("e", 2, "Only this")]
    titles = [("d", k, " ".join(rng.choices([*parts, "zz", "qqqq", "methods"], k=rng.randrange(0, 9)))) for k in range(120)] + [("e", 500, "this only"), ("e", 501, None), ("f", 502, "none here"), ("d", 503, "  Art  of "), ("e", 504, "thiss")]
    found = matching.title_spans(spark.createDataFrame(titles, "pdf_filename string, title_id int, title string"), spark.createDataFrame(spans, "pdf_filename string, place int, content string"))
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    want = {(d, i, *x) for d, i, t in titles if (x := shown(t, [(p, s) for e, p, s in spans if e == d]))}
    assert {tuple(r) for r in found.collect()} == want and {r[3] for r in want} == {1, 2, 3}


@pytest.mark.parametrize("cell", [7.0, 64.0, 5000.0])
def test_boxes_meet_once_whatever_the_cells(spark, cell):
    rng = random.Random(3)
    side = lambda: sorted(rng.choice([rng.uniform(-50, 300), float(rng.randrange(0, 300, 64))]) for _ in range(2))
    rows = [(f"d{k % 2}", k % 3, k, *side(), *side()) for k in range(90)]
    df = spark.createDataFrame([(d, p, k, x0, y0, x1, y1) for d, p, k, x0, x1, y0, y1 in rows] + [("d0", 0, 900, 9.0, 9.0, 1.0, 1.0), ("d0", 0, 901, None, 1.0, 2.0, 2.0)], "pdf_filename string, page_number int, k int, x0 double, y0 double, x1 double, y1 double")
    b = spatial.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    found = [tuple(r) for r in spatial.meeting(df.select("pdf_filename", "page_number", F.col("k").alias("i"), b.alias("area")), df.select("pdf_filename", "page_number", F.col("k").alias("j"), b.alias("spot")), cell).select("i", "j").collect()]
    want = {(i, j) for d, p, i, x0, x1, y0, y1 in rows for e, q, j, a0, a1, b0, b1 in rows if (d, p) == (e, q) and x0 <= a1 and x1 >= a0 and y0 <= b1 and y1 >= b0}
    assert len(found) == len(set(found)) and set(found) == want


def test_links_are_taken_in_order_and_within_reach(spark):
    kind = "pdf_filename string, page_number int, {} int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    entries = spark.createDataFrame([("d", 1, 1, (0.0, 0.0, 100.0, 10.0)), ("d", 1, 2, (0.0, 50.0, 100.0, 60.0)), ("d", 2, 3, (0.0, 0.0, 9.0, 9.0)), ("d", 1, 4, (40.0, 200.0, 60.0, 210.0))], kind.format("entry_id"))
    links = spark.createDataFrame([("d", 1, 7, (95.0, 5.0, 200.0, 9.0), 70), ("d", 1, 5, (105.0, 18.0, 200.0, 30.0), 50), ("d", 1, 9, (0.0, 69.0, 9.0, 80.0), 90), ("d", 1, 3, (0.0, 215.0, 500.0, 220.0), 30)], kind.format("ord") + ", dest_page int")
    # The last link is below entry 4 within reach, but no side of it is near across.
    assert {tuple(r) for r in spatial.link_targets(entries, links).collect()} == {("d", 1, 5, 50), ("d", 2, 9, 90)}


def test_links_in_turns_are_the_first_ones(spark):
    rng = random.Random(8)
    kind = "pdf_filename string, page_number int, {} int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    sides = lambda: (x := rng.uniform(0, 400), y := rng.uniform(0, 400), x + rng.uniform(1, 40), y + rng.uniform(1, 40))
    boxes, spots = ([("d", rng.randrange(2), k, sides()) for k in range(n)] for n in (60, 90))
    near = lambda p, q, a, b: min(abs(p[a] - q[b]), abs(p[b] - q[a]), abs(p[b] - q[b]), abs(p[a] - q[a])) <= 10
    meet = lambda p, q: p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1] or near(p, q, 0, 2) and near(p, q, 1, 3)
    want = {(d, i, k, k % 7) for d, page, i, p in boxes for k in [min((k for _, other, k, q in spots if other == page and meet(p, q)), default=None)] if k is not None}
    links = spark.createDataFrame([(*s, s[2] % 7) for s in spots], kind.format("ord") + ", dest_page int")
    assert {tuple(r) for r in spatial.link_targets(spark.createDataFrame(boxes, kind.format("entry_id")), links, first=2, step=3).collect()} == want


def test_tables_of_ragged_rows(spark):
    spans = [("r", 10.0, 0.0, 20.0, "a"), ("r", 25.0, 2.0, 30.0, " b "), ("r", 60.0, 4.0, 70.0, "c"), ("r", 10.0, 20.0, 20.0, "d"), ("r", 10.0, 24.0, 12.0, "  "), ("r", 50.0, 24.9, 60.0, "e"), ("r", 90.0, 25.0, 99.0, "f"), ("s", 1.0, 1.0, 2.0, "\t"), ("t", 1.0, 1.0, 2.0, "one")]
    df = spark.createDataFrame([("d", 1, *s) for s in spans], "pdf_filename string, page_number int, region string, x0 double, y0 double, x1 double, content string")
    assert {r.region: r.grid for r in spatial.table_grids(df).collect()} == {"r": [["a b", "c", ""], ["d", "e", "f"]], "t": [["one"]]}
    assert spatial.table_grids(df.limit(0)).count() == 0
    # Spans are passed once: no second branch makes the empty cells.
    assert "Union" not in spatial.table_grids(df)._jdf.queryExecution().optimizedPlan().toString()


def parted(text):
    """Paragraphs by going through the lines."""
    blocks = [b.strip() for b in (text or "").split("\n\n") if b.strip()]
    good = [b for b in blocks if len(b) > 50 or (len(b) > 20 and "." in b)]
    if len(blocks) > 1 and good:
        return good
    lines, texts, out = [x.strip() for x in (text or "").split("\n") if x.strip()], [], []
    for k, x in enumerate(lines):
        if k and not (lines[k - 1].endswith(".") and x[0].isupper()) and len(texts[-1]) <= 800:
            texts[-1] += " " + x
        else:
            texts.append(x)
    for x in (t for t in texts if len(t) > 20):
        if out and len(x) < 100 and len(out[-1]) < 400:
            out[-1] += " " + x
        else:
            out.append(x)
    return out


def test_paragraphs_follow_the_lines(spark):
    rng = random.Random(11)
    line = lambda: rng.choice(["", " ", "Éa", "the"]) + "w" * rng.choice([1, 5, 22, 60, 130, 420, 900]) + rng.choice(["", ".", " x. ", "  "])
    texts = [None, "", " \n\n ", "short", "A.\nB", *("\n".join(rng.choice([line(), line().capitalize(), ""]) for _ in range(rng.randrange(1, 25))) for _ in range(150))]
    texts += [t.replace("\n\n", "\n") for t in texts[5:80]]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "pdf_filename string, page_number int, content string")
    found: dict = {}
    for r in layout.paragraph_positions(df).orderBy("page_number", "paragraph_index").collect():
        found.setdefault(r.page_number, []).append(r.text)
    assert found == {k: p for k, t in enumerate(texts) if (p := parted(t))}


def test_hits_on_the_page_and_beside_it(spark):
    spans = [("d", 1, 1, " The  first—line "), ("d", 1, 2, ""), ("d", 1, 3, "of ‘Page’ one. " + "x" * 120), ("d", 1, 4, "far away"), ("d", 2, 1, "the first-line of page"), ("d", 4, 1, "the first-line of"), ("e", 1, 1, "first")]
    wanted = [(1, "d", 1, "first-line of"), (2, "d", 1, "line of"), (3, "d", 1, " "), (4, "d", 1, None), (5, "d", None, "first"), (6, "d", 3, "FIRST"), (7, "d", 1, "far")]
    s, w = spark.createDataFrame(spans, "pdf_filename string, page_number int, ord int, content string"), spark.createDataFrame(wanted, "query_id int, pdf_filename string, page_number int, text string")
    exact = sorted((r.query_id, r.page_number, r["place"], r.ord) for r in pagesearch.hits(s, w, False).collect())
    assert exact == [(1, 2, 4, 1), (2, 1, 11, 1), (2, 1, 11, 3), (2, 2, 10, 1), (7, 1, 152, 4)]
    plain = sorted((r.query_id, r.page_number, r.ord) for r in pagesearch.hits(s, w).collect())
    assert plain == [(1, 1, 1), (1, 1, 3), (1, 2, 1), (2, 1, 1), (2, 1, 3), (2, 2, 1), (6, 2, 1), (6, 4, 1), (7, 1, 3), (7, 1, 4)]
