
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import catalog, chunking, citations, history, layout, pages, retrieval, spatial
from marginalia.operators.catalog import Scope
from marginalia.sources import providers, stages


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("query", "mode", "wanted"),
    [
        ("single", "observed", []), ("two words", "observed", ["two words"]), ('find "exact phrase" here', "observed", ['find "exact phrase" here', "exact phrase"]),
        ('say "" now', "observed", ['say "" now']), ("the economic welfare question", "intended", ["the economic welfare question", "welfare", "question"]),
    ],
)
def test_rule_keywords(spark, query, mode, wanted):
    assert one(spark, retrieval.rule_keywords(F.col("q"), mode), q=query) == wanted


@pytest.mark.parametrize(
    ("content", "keyword", "score"),
    [
        ("Alpha", "Alpha", 1.0 * 1.5 * 1.5), ("alpha alpha", "Alpha", 1.5 * 2), ("alpha alpha alpha", "alpha", 1.5 * 3), ("the fox", "fox", 0.3 * 1.5 * 1.5),
        ("health", "health", 0.1 * 1.5 * 1.5), ("red fox", "red fox", 3 * 1.5 * 1.5), (" ".join(["alpha"] * 21), "alpha", 1.5 * 0.7 * 21), (" ".join(["alpha"] * 20), "alpha", 1.5 * 20), ("none", "alpha", 0.0),
    ],
)
def test_keyword_weight(spark, content, keyword, score):
    assert one(spark, retrieval.keyword_weight(F.col("c"), F.col("k"), F.lit(0)), c=content, k=keyword) == pytest.approx(score)


def test_similarity_is_clamped(spark):
    d = retrieval.squared_distance
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))
    assert one(spark, retrieval.half_similarity(d(a, a)), i=1) == 1.0
    assert one(spark, retrieval.half_similarity(d(a, b)), i=1) == 0.0


def test_fusion_of_disjoint_and_equal_lists(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1)], "query_id int, chunk_id string, rank int")
    rows = retrieval.fused([(a, 1.0), (b, 1.0), (a, 1.0)], 5).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["x", "y", "z"]
    assert rows[0].score == pytest.approx(2 / 61, abs=1e-8)


def test_bm25_floor_for_common_terms_and_empty_text(spark):
    chunks = spark.createDataFrame([("a", "common rare"), ("b", "common"), ("c", "common other"), ("d", "")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "common"), (2, "rare rare"), (3, "absent")], "query_id int, query string")
    rows = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(chunks, queries, 10).collect()}
    assert {k for k in rows if k[0] == 1} == {(1, "a"), (1, "b"), (1, "c")}
    assert rows[2, "a"] > 0 and len([k for k in rows if k[0] == 3]) == 0


def test_scopes(spark):
    c = spark.createDataFrame([("d1", "child", "Intro", 3), ("d1", "parent", "Intro", 4), ("d2", "child", "Introduction", 5)], "pdf_filename string, chunk_type string, toc_title string, page_number int")
    count = lambda s: c.filter(s.condition()).count()
    assert count(Scope()) == 3 and count(Scope("child", ("d1",))) == 1 and count(Scope(sections=("Intro",))) == 2
    assert count(Scope(sections=("INTRO",), partial_titles=True)) == 3 and count(Scope(pages=(4, 5))) == 2
    assert [s.mode for s in (Scope(), Scope(documents=("a",)), Scope(documents=("a", "b")), Scope(sections=("s",)), Scope(pages=(1, 2)))] == ["collection", "pdf", "group", "toc_section", "page_range"]


@pytest.mark.parametrize(("first", "last", "budget", "n"), [(1, 1, 6000, 1), (1, 8, 6000, 7), (1, 9, 6000, 0), (1, 10, 8000, 9), (1, 11, 80000, 0), (5, 4, 6000, 0)])
def test_full_pages(spark, first, last, budget, n):
    p = spark.createDataFrame([("d", k, " " if k == 3 else f"page {k}") for k in range(1, 13)], "pdf_filename string, page_number int, content string")
    assert pages.full_pages(p, "d", first, last, budget).count() == n


def test_ranges_and_merge(spark):
    toc = spark.createDataFrame([("d", "A", 1), ("d", "B", 1), ("d", "C", 5), ("e", "Z", 7)], "pdf_filename string, title string, page_number int")
    ranges = {(r.pdf_filename, r.title): (r.start_page, r.end_page) for r in pages.section_ranges(toc).collect()}
    assert ranges == {("d", "A"): (1, 4), ("d", "B"): (1, 4), ("d", "C"): (5, 15), ("e", "Z"): (7, 17)}
    r = spark.createDataFrame([("d", 1, 4), ("d", 5, 6), ("d", 9, 9), ("d", 2, 3)], "pdf_filename string, start_page int, end_page int")
    assert sorted((x.start_page, x.end_page) for x in pages.merged(r).collect()) == [(1, 6), (9, 9)]


def test_running_lines(spark):
    spans = [("d", p, 20.0, "  The  Title ") for p in (1, 2, 3)] + [("d", p, 400.0, "Body text") for p in (1, 2, 3, 4, 5)] + [("d", 4, 20.0, "Other"), ("d", 5, 20.0, "Third"), ("one", 1, 20.0, "Alone"), ("one", 1, 20.0, "Alone")]
    df = spark.createDataFrame(spans, "pdf_filename string, page_number int, y0 double, content string")
    found = layout.running_lines(df)
    assert [(r.band, r.y_band, r.text, r.seen) for r in found.collect()] == [("header", 20, "the title", 3)]
    assert layout.without_running_lines(df, found).count() == len(spans) - 3


@pytest.mark.parametrize(("y", "bucket"), [(2.5, 0), (7.5, 10), (12.4, 10)])
def test_bands_round_half_to_even(spark, y, bucket):
    assert one(spark, F.bround(F.col("y") / 5.0) * 5, y=y) == bucket


@pytest.mark.parametrize(
    ("text", "kind"),
    [("1. Title", "heading"), ("2) item text", "list"), ("John Smith", "paragraph"), ("Abstract", "paragraph"), ("Introduction to it", "heading"), ("x" * 101, "paragraph"), ("A LONG UPPER LINE", "heading"), ("- point one", "list"), ("plain words here now", "paragraph"), ("iv. part", "list")],
)
def test_block_types(spark, text, kind):
    assert one(spark, layout.block_type(F.col("t")), t=text) == kind


def test_toc_links(spark):
    toc = spark.createDataFrame([("d", 0, "Front", None, 2), ("d", 1, "A", 3, 1), ("d", 2, "B", 5, 2), ("d", 3, "C", 5, 1)], "pdf_filename string, ord int, title string, page_number int, level int")
    blocks = spark.createDataFrame([("d", 1), ("d", 3), ("d", 4), ("d", 5), ("d", 6)], "pdf_filename string, page_number int")
    found = {r.page_number: r.toc_title for r in layout.toc_links(blocks, toc).collect()}
    assert found == {1: "Front", 3: "A", 4: "A", 5: "A", 6: "C"}


@pytest.mark.parametrize(("sizes", "wanted"), [([180.0, 170.0], [0, 0]), ([180.0, 171.0], [0, 1]), ([179.0, 300.0, 10.0], [0, 0, 1]), ([400.0, 1.0], [0, 1]), ([], [])])
def test_child_breaks(spark, sizes, wanted):
    df = spark.createDataFrame([(sizes,)], "t array<double>")
    assert df.select(chunking.child_breaks(F.col("t"))).first()[0] == wanted


@pytest.mark.parametrize(("n", "kept"), [(38, 0), (39, 1)])
def test_short_tails_go(spark, n, kept):
    df = spark.createDataFrame([(1, " ".join(["word"] * n) + ".")], "doc_id int, content string")
    assert chunking.child_chunks(df).count() == kept


def test_sentences_lose_marks_and_split_decimals(spark):
    assert one(spark, X.sentences(F.col("t")), t="One 3.5 two! ... Three?") == ["One 3", "5 two", "Three"]


def test_sections(spark):
    rows = [("d", 1, 1, "heading", "Introduction part", None), ("d", 2, 1, "paragraph", "text a", None), ("d", 3, 2, "table", "| t |", None), ("d", 4, 2, "paragraph", "text b", "New"), ("d", 5, 3, "paragraph", "text c", "Next")]
    df = spark.createDataFrame(rows, "pdf_filename string, place long, page_number int, block_type string, content string, toc_title string")
    found = [(r.title, r.content) for r in chunking.sections(df).orderBy("section").collect()]
    assert found == [("Introduction part", "Introduction part\n\ntext a"), ("Untitled Section", "| t |"), ("New", "text b"), ("Next", "text c")]


def test_history_budget_keeps_the_newest(spark):
    big = " ".join(["w"] * 2000)
    t = spark.createDataFrame([("c", 1, "a b", "c"), ("c", 2, big, "x")], "collection string, ord int, user_message string, assistant_response string")
    assert [r.ord for r in history.recent(t, ["collection"], ["ord"]).collect()] == [2]


def test_citations(spark):
    a = spark.createDataFrame([(1, '<citation pdf_name="d.pdf" page_number="2" chunk_id="c1" cited_text="The quick, brown fox">'), (2, "<citation pdf_name='d.pdf' page_number='9' chunk_id='c2' cited_text='four'>"), (3, "none")], "answer_id int, answer string")
    found = citations.extract(a)
    assert {(r.answer_id, r.cited_text) for r in found.collect()} == {(1, "The quick, brown fox"), (2, "four")}
    p = spark.createDataFrame([("d.pdf", 3, "saw the quick brown fox run"), ("d.pdf", 5, "the quick, brown fox")], "pdf_filename string, page_number int, content string")
    assert [(r.answer_id, r.found_page, r.strategy) for r in citations.locate(found, p).collect()] == [(1, 3, 3)]
    assert one(spark, citations.label(F.col("n")), n="a" * 25 + ".pdf") == "a" * 25
    assert one(spark, citations.label(F.col("n")), n="a" * 26 + ".pdf") == "a" * 22 + "..."


def test_ledger_matches_whole_names(spark):
    files = spark.createDataFrame([("x", "b.pdf"), ("x_y", "a_b.pdf"), ("n", "c.pdf")], "collection string, pdf_filename string")
    ledger = spark.createDataFrame([("x", "a_b.pdf"), ("o", "c.pdf")], "collection string, pdf_filename string")
    assert catalog.new_files(files, ledger).count() == 3
    assert {(r.pdf_filename, r.old_collection) for r in catalog.moved_files(files, ledger).collect()} == {("a_b.pdf", "x"), ("c.pdf", "o")}
    assert catalog.orphans(ledger, files).count() == 2


def test_grid(spark):
    df = spark.createDataFrame([([["a", " ", "b "], ["", "", ""], ["c"]],), ([],)], "g array<array<string>>")
    assert [r[0] for r in df.select(layout.clean_grid(F.col("g"))).collect()] == [[["a", "b"], ["c", ""]], []]
    assert df.select(layout.markdown(layout.clean_grid(F.col("g")))).first()[0] == "| a | b |\n| --- | --- |\n| c |  |"


def test_requests(spark):
    ask = lambda q: one(spark, history.content_request(F.col("q")), q=q)
    assert [ask("Show the TABLE"), ask("how to configure"), ask("an overview"), ask("why")] == ["table", "figure", "parent", None]


def test_footnotes_captions_lines(spark):
    s = spark.createDataFrame([("d", 1, 700.0, 10.0, "stray", 8.0, 20.0, 708.0), ("d", 1, 710.0, 10.0, "1 first", 8.0, 50.0, 718.0), ("d", 1, 720.0, 10.0, "goes on", 8.0, 60.0, 728.0), ("d", 1, 730.0, 10.0, "2 second", 8.0, 40.0, 738.0)], "pdf_filename string, page_number int, y0 double, x0 double, content string, font_size double, x1 double, y1 double")
    assert [(r.reference_number, r.content) for r in layout.footnotes(s).orderBy("note").collect()] == [("1", "1 first goes on"), ("2", "2 second")]
    assert [r.line for r in layout.lines_of_spans(s).orderBy("y0").collect()] == [0, 1, 2, 3]
    boxes = spark.createDataFrame([("d", 1, "b1", 0.0, 600.0, 100.0, 690.0)], "pdf_filename string, page_number int, box_id string, x0 double, y0 double, x1 double, y1 double")
    assert spatial.captions(boxes, s).first().caption == "stray"


def test_content_filter_falls_back_to_all(spark):
    r = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "query_id int, chunk_id string, hit boolean")
    assert {x.chunk_id for x in history.of_requested_type(r, F.col("hit")).collect()} == {"a", "c"}


def test_providers(spark):
    df = providers.embedded(spark.createDataFrame([("x",), ("y",)], "content string"), "content", lambda t: [[1.0, 2.0] for _ in t])
    assert df.first().embedding == [1.0, 2.0]
    a = spark.createDataFrame([(1, 1, "one", "medium"), (1, 2, "two", "high"), (2, 1, "three", "low")], "query_id int, answer int, text string, confidence string")
    assert {r.query_id: r.text for r in providers.pick_by_confidence(a).collect()} == {1: "two", 2: "three"}


def test_ingest_stream(spark, tmp_path):
    from marginalia.streaming.ingest import ingest

    row = '{"collection": "c", "pdf_filename": "%s", "chunk_id": "%s", "content": "%s"}\n'
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(row % ("a.pdf", "1", "x") + row % ("a.pdf", "2", " ") + row % ("b.pdf", "3", "y"))
    go = lambda: ingest(spark, str(source), str(tmp_path / "store"), str(tmp_path / "check"), str(tmp_path / "ledger")).awaitTermination()
    go()
    (source / "2.json").write_text(row % ("a.pdf", "9", "new"))
    go()
    assert {(r.pdf_filename, str(r.chunk_id)) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {("a.pdf", "9"), ("b.pdf", "3")}


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c", "f.pdf")], stages.SCHEMAS["ledger"])
    stages.write_stage(df, str(tmp_path / "l"))
    assert stages.read_stage(spark, "ledger", str(tmp_path / "l")).collect() == df.collect()


def test_plans_stay_in_the_jvm_and_push_filters(spark, sf):
    from marginalia.plans.catalogue import QUERIES

    plan = QUERIES["page_range_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "source" in plan.split("PushedFilters")[1][:200] and "Python" not in plan
    assert "WindowGroupLimit" in QUERIES["knn_topk"](spark, sf)._jdf.queryExecution().toString()


def test_long_paragraphs_are_split(spark):
    import random
    import re

    def parts(text):
        if len(text) <= 800:
            return [text]
        done, part, size = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
            s = s.strip()
            if s and part and size + len(s) > 600 and (size > 400 or s.startswith(tuple(chunking.STARTERS))):
                done.append(" ".join(part))
                part, size = [], 0
            if s:
                part.append(s)
                size += len(s)
        done += [" ".join(part)] if part else []
        return [p.strip() for p in done if len(p.strip()) > 50] or [text]

    rng = random.Random(4)
    texts = ["", "short", "x" * 900, "A. " * 400]
    for _ in range(40):
        texts.append(" ".join(rng.choice(["However, ", "Then ", "Another ", "the "]) + "word " * rng.randrange(1, 90) + rng.choice([".", "!", " no end"]) for _ in range(rng.randrange(1, 20))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", chunking.paragraph_parts(F.col("t")).alias("p")).collect()
    assert {r.k: r.p for r in rows} == {k: parts(t) for k, t in enumerate(texts)}


def test_answers_as_the_json_library_reads_them(spark):
    import json

    from marginalia.functions import answers

    texts = [
        '{"found_answer": false, "confidence": "low", "response": "a \\"b\\" é"}', "{}", '{"response": null}', '{"response": {"x": [1, {"y": "}"}]}}', "{'response': 'single'}", '{"a": 1} x', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}',
        '{"a": 1}} x', '{"a": 1}], [', "[1]", '"text"', "", "plain", '{"response": "open', '{"response": "x",}', '  {"confidence": "high"}  ', '{"response": "x"}, "b": 2', '{"response": 5}', None,
    ]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", answers.answer(F.col("t")).alias("a")).select("k", "a.*").collect()
    for r in found:
        text = texts[r.k]
        try:
            whole = json.loads(text or "")
        except ValueError:
            whole = None
        if not isinstance(whole, dict):
            assert (r.found_answer, r.confidence, r.response, r.unread) == ("true", "medium", text, text), text
            continue
        plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        assert (r.found_answer, r.confidence, r.response, r.unread) == (plain(whole.get("found_answer", True)), whole.get("confidence", "medium"), plain(whole.get("response", text)), None), text


def test_fences(spark):
    from marginalia.functions import answers

    texts = {" ```json\n{}\n``` ": "{}", "```x```": "x", "`x`": "x", "json {}": "{}", "{}\\\\ \n\\": "{}", "``` a": "``` a", "`": "", "": "", "{}": "{}"}
    found = spark.createDataFrame(list(texts.items()), "t string, want string").select("t", "want", answers.unfenced(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in found] == [(r.t, r.want) for r in found]


def test_keywords_meet_only_chunks_that_hold_their_longest_word(spark):
    texts = [("a", "Underwater basket weaving"), ("b", "a water bask"), ("a", "under     here"), (None, "ends wate r bas"), ("d", None), ("e", "nothing")]
    asked = [(1, "water bask"), (2, 'say "     " now'), (None, "te r ba"), (4, "absent words"), (1, "nothing else")]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    found = retrieval.keyword_search(chunks, queries, "intended")
    keys = {r.query: r.k for r in queries.select("query", retrieval.rule_keywords(F.col("query"), "intended").alias("k")).collect()}
    want = [(i, c, "|".join(k for k in keys[q] if k.lower() in (t or "").lower())) for i, q in asked for c, t in texts if any(k.lower() in (t or "").lower() for k in keys[q])]
    order = lambda rows: sorted(rows, key=str)
    assert len(want) > 4 and order((r.query_id, r.chunk_id, r.matched_keywords) for r in found.collect()) == order(want)
    # Texts are joined with what was found for them, not with all queries.
    assert "_c#" in found._jdf.queryExecution().optimizedPlan().toString()
