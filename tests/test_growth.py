"""Steps whose rows must grow with their input and not with its square, each against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from marginalia.functions import answers
from marginalia.operators import bm25index, chunking, citations, matching, retrieval, spatial

from tests.test_index_and_joins import shown


def rows_made(df, kinds=("Join", "GenerateExec")):
    """The rows of df, and the most rows that one step of these kinds in its plan made."""
    found, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if any(kind in name for kind in kinds):
            metric = p.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
    return found, most


def test_captions_of_a_dense_page(spark):
    rng = random.Random(5)
    boxes = [("d", 1, k, *(x := rng.randrange(300), y := rng.randrange(300)), x + 200.0, y + 20.0, rng.choice(["table", "figure"])) for k in range(300)]
    boxes = [(d, p, k, float(x0), float(y0), x1, y1, kind) for d, p, k, x0, y0, x1, y1, kind in boxes] + [("d", 2, 300, 0.0, 0.0, 1.0, 1.0, "figure"), (None, 1, 301, 0.0, 0.0, 9.0, 9.0, "table"), ("d", 1, 302, None, 0.0, 9.0, 9.0, "table")]
    spans = [("d", 1, rng.choice(["Figure 3: a", "b", "note", "long " * 60]) + str(rng.randrange(5)), rng.randrange(800) / 2, rng.randrange(1600) / 4) for _ in range(3000)] + [("d", 1, None, 5.0, 5.0), (None, 1, "Table 1", 5.0, 5.0), ("d", 1, "note", None, 5.0)]
    found, most = rows_made(spatial.captions(spark.createDataFrame(boxes, "pdf_filename string, page_number int, box_id int, x0 double, y0 double, x1 double, y1 double, kind string"), spark.createDataFrame(spans, "pdf_filename string, page_number int, content string, x0 double, y0 double")))
    want = {}
    for d, p, k, x0, y0, x1, y1, kind in boxes:
        fit = []
        for e, q, content, x, y in spans if x0 is not None and d else []:
            low, high = (y0 - 50, y0) if kind == "table" else (y1, y1 + 50)
            if (d, p) == (e, q) and None not in (content, x) and x0 - 30 <= x <= x1 + 30 and low <= y <= high:
                rank = 1 if re.match(r"(figure|table)\s*\d", content, re.I) else 2 if len(content) < 200 else None
                fit += [(rank, y, x, content)] if rank else []
        want[k] = min(fit)[3] if fit else None
    assert {r.box_id: r.caption for r in found} == want and len(found) == len(boxes)
    # Pairs of a box and a span in its area.
    met = sum(1 for b in boxes[:300] for s in spans[:3000] if b[3] - 30 <= s[3] <= b[5] + 30 and abs(s[4] - (b[4] - 25 if b[7] == "table" else b[6] + 25)) <= 25)
    assert most < met / 2


def test_bm25_shuffles_asked_terms_only(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = [(f"c{k}", " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(200)] + [("c7", "w1 w2"), ("c7", "w1 w2"), ("null", None), ("blank", " ")]
    asked = spark.createDataFrame([(1, "w1 w2 w1"), (2, "w9 unheard"), (3, "")], "query_id bigint, query string")

    def plain(rows):
        groups = Counter()
        for c, text in rows:
            t = (text or "").split()
            for w in t:
                groups[c, len(t), w] += 1
        df = Counter(w for _, _, w in groups)
        n, mean = len(rows), sum(len(x.split()) for _, x in rows if x is not None) / sum(x is not None for _, x in rows)
        raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
        scores = Counter()
        for q, query in ((1, "w1 w2 w1"), (2, "w9 unheard")):
            for (c, length, w), tf in groups.items():
                scores[q, c] += query.split().count(w) * idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
        best = {q: sorted(((-s, c) for (p, c), s in scores.items() if p == q and round(s, 6) > 0))[:5] for q in (1, 2)}
        return {(q, c): -s for q, found in best.items() for s, c in found}

    for some in (rows, rows[:200] + rows[202:]):
        found = retrieval.bm25(spark.createDataFrame(some, "chunk_id string, content string"), asked, 5).collect()
        assert {(r.query_id, r.chunk_id): r.score for r in found} == pytest.approx(plain(some), abs=2e-6)
    # Terms that no query asks are not grouped by chunk.
    assert rows_made(retrieval.bm25(spark.createDataFrame(rows[:200], "chunk_id string, content string"), asked, 5), ["HashAggregateExec"])[1] < 200


def test_stored_scores_stay_with_their_chunks(spark, tmp_path):
    index = bm25index.StoredBm25(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([("x", "a", f"c{k}", f"w{k % 3} common") for k in range(9)], "collection string, pdf_filename string, chunk_id string, content string"))
    found = index.search(spark.createDataFrame([(1, "w1 common"), (2, "w2")], "query_id bigint, query string"), 5)
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 6 and "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id#" in plan
    assert not re.search(r"hashpartitioning\(query_id#\w+, collection", plan)


def test_titles_of_frequent_words_leave_early(spark, monkeypatch):
    rng, met, own = random.Random(9), [], matching.candidates

    def counted(*given):
        found = own(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(matching, "candidates", counted)
    parts = ["the", "of", "Theory", "art", "party", "a", "x.", "Ähre"]
    spans = [("d", k, " ".join(rng.choices(parts, k=rng.randrange(0, 7))) + (f"  rare{k}" if k % 7 == 0 else "")) for k in range(300)] + [("e", 1, None), ("e", 2, "\tOnly this "), (None, 3, "the art")]
    titles = [("d", k, " ".join(rng.choices([*parts, "he", "ar", "are", "rare14", "rare287", "qqqq", "zz"], k=rng.randrange(0, 8)))) for k in range(300)] + [("d", 800, "art  of"), ("d", 801, "the  rare70"), ("e", 802, "this"), (None, 803, "the art"), ("e", 804, None), ("d", 805, "the of"), ("d", 805, "rare280"), ("d", 806, "Theory qxq vzv zzk kqk")]
    want = {}
    for d, i, t in titles:
        x = shown(t, [(p, s) for e, p, s in spans if e == d]) if d else None
        if x:
            want[d, i] = min(x[::-1], want.get((d, i), x[::-1]))
    df = spark.createDataFrame(titles, "pdf_filename string, title_id int, title string"), spark.createDataFrame(spans, "pdf_filename string, place int, content string")
    for first, dense in ((4, 1), (32, 256)):
        assert {(r.pdf_filename, r.title_id): (r.rule, r.place) for r in matching.title_spans(*df, first, dense).collect()} == want
    assert {x[0] for x in want.values()} == {1, 2, 3} and sum(met) < len(titles) * len(spans) / 8


def test_titles_of_one_word_meet_no_spans(spark, monkeypatch):
    met, own = [], matching.candidates

    def counted(*given):
        found = own(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(matching, "candidates", counted)
    spans = [("d", k, "early words" if k < 300 else f"They came later w{k}") for k in range(600)]
    titles = [("d", k, title) for k, title in enumerate(["later", "ATE", " w599", "nowhere", "ear"])]
    found = matching.title_spans(spark.createDataFrame(titles, "pdf_filename string, title_id int, title string"), spark.createDataFrame(spans, "pdf_filename string, place int, content string"))
    assert {tuple(r) for r in found.collect()} == {("d", 0, 300, 1), ("d", 1, 300, 1), ("d", 2, 599, 1), ("d", 4, 0, 1)}
    # Before, there were 601 such pairs.
    assert sum(met) == 0


def test_citations_meet_texts_that_share_words(spark):
    rng, own = random.Random(3), citations.strategy
    words = ["The", "cité", "of", "a", "Maße", "theory", "re-read", "x", "“no”", "end.", "word_s", "12"] + [f"w{k}q" for k in range(60)]
    pages = [("d", k % 4 + 1, " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", "\n", " — "])) for k in range(80)] + [("d", 2, None), ("e", 1, "Other one's text"), (None, 1, "The end.")]
    cited = []
    for k in range(120):
        d, page, text = pages[rng.randrange(80)]
        w = text.split()
        at = rng.randrange(0, max(1, len(w)))
        cut = rng.choice(["  ", " "]).join(w[at : at + rng.randrange(1, 18)])
        cited.append((k, d, str(max(1, page + rng.choice([-1, 0, 0, 1]))), f"c{k}", rng.choice([cut, cut.upper(), cut[1:-1], cut + " zz", cut.replace("é", "")])))
    cited += [(200, "d", "2", "c", "—————"), (201, "e", "2", "c", "one's"), (202, "e", "9", "c", "Other one's"), (203, "d", "1", "c", "the"), (204, "d", "3", "c", None)]
    c = spark.createDataFrame(cited, "answer_id int, pdf_name string, page_number string, chunk_id string, cited_text string")
    p = spark.createDataFrame(pages, "pdf_filename string, page_number bigint, content string")
    every = c.filter("length(cited_text) >= 5").withColumn("cited", citations.cited_forms(F.col("cited_text"))).drop("cited_text").withColumnRenamed("page_number", "page")
    every = every.crossJoin(p).filter("pdf_name = pdf_filename and abs(page_number - cast(page as bigint)) <= 1")
    every = every.withColumn("strategy", own(F.col("content"), citations.normal(F.col("content")), citations.only_words(F.col("content")), F.col("cited"))).cache()
    want = {}
    for r in every.filter("strategy is not null").collect():
        want[r.answer_id] = min(want.get(r.answer_id, (99, 99)), (r.page_number, r.strategy))
    located = citations.locate(c, p)
    # Texts are not compared within a join of all citations and texts of a page.
    assert not re.search(r"Join[^\n]*[Cc]ontains\(", located._jdf.queryExecution().optimizedPlan().toString())
    found, most = rows_made(located)
    assert {r.answer_id: (r.found_page, r.strategy) for r in found} == want and len(found) == len(want)
    assert len({x[1] for x in want.values()}) > 3 and most < every.count() / 2


def test_answers_are_made_and_parsed_once(spark):
    made = F.concat(F.lit('{"response": "'), F.reverse("t"), F.lit('"}'))
    a = spark.createDataFrame([("abc",), (None,)], "t string").select(answers.answer(answers.unfenced(made)).alias("a")).select("a.*")
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("from_json(") <= 2
    assert [tuple(r) for r in a.collect()] == [("true", "medium", "cba", None), ("true", "medium", None, None)]


def test_heads_of_chunks_are_made_once(spark):
    chunks = spark.createDataFrame([(1, 0, "a  b c d e f g h i j k l"), (1, 1, "m n"), (1, 2, "none of these"), (2, 0, "x")], "doc_id int, chunk int, content string")
    blocks = spark.createDataFrame([(1, 0, 5, "zero"), (1, 1, 6, "a b c d e f g h i j\nand on"), (1, 2, 7, "l m\tn"), (2, 0, 8, None)], "doc_id int, line int, page_number int, content string")
    found = chunking.chunk_pages(chunks, blocks)
    assert {tuple(r) for r in found.collect()} == {(1, 0, 6), (1, 1, 7), (1, 2, 5), (2, 0, 8)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
