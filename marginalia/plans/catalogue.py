"""Queries by name: each applies one operator to the views of the input tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import answers
from marginalia.functions import text as X
from marginalia.operators import bm25index, catalog, chunking, citations, elements, history, layout, matching, pages, pagesearch, paragraphs, retrieval, routing, spatial
from marginalia.operators.catalog import Scope
from marginalia.sources import batch, shared, views

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _child(spark, sf):
    return views.chunks(spark, sf).filter(Scope(chunk_type="child").condition())


@query
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.collection_stats(views.chunks(spark, sf, False))


@query
def chunks_per_doc(spark, sf):
    return catalog.chunks_per_document(views.chunks(spark, sf, False))


@query
def available_docs(spark, sf):
    return catalog.available_documents(views.chunks(spark, sf, False))


@query
def collections_listing(spark, sf):
    return catalog.collections_listing(views.chunks(spark, sf, False))


@query
def toc_sections(spark, sf):
    return catalog.sections_of_documents(views.chunks(spark, sf, False))


@query
def scope_filter(spark, sf):
    scope = Scope("child", ("src1", "src3"), ("Section 1", "Section 2"))
    return views.chunks(spark, sf, False).filter(scope.condition()).select("chunk_id", "pdf_filename", "toc_title", "page_number")


@query
def page_range_filter(spark, sf):
    return views.chunks(spark, sf, False).filter(Scope("child", ("src2",), pages=(5, 20)).condition()).select("chunk_id", "page_number")


@query
def partial_title_match(spark, sf):
    return views.chunks(spark, sf, False).filter(Scope(sections=("the section 2 and more", "TION 3"), partial_titles=True).condition()).select("chunk_id", "toc_title")


@query
def knn_topk(spark, sf):
    return retrieval.knn(views.chunks(spark, sf), views.queries(spark, sf), 10)


@query
def knn_filtered(spark, sf):
    return retrieval.knn(_child(spark, sf).filter(F.col("pdf_filename").isin("src0", "src1", "src2", "src3")), views.queries(spark, sf), 5)


@query
def knn_similarity(spark, sf):
    near = retrieval.knn(views.chunks(spark, sf), views.queries(spark, sf), 3, digits=10)
    return near.select("query_id", "chunk_id", F.round(retrieval.half_similarity(F.col("distance")), 6).alias("half_similarity"), F.round(1.0 - F.col("distance"), 6).alias("direct_similarity"))


@query
def knn_per_document(spark, sf):
    return retrieval.knn(views.chunks(spark, sf), views.queries(spark, sf), 3, ("pdf_filename",))


@query
def tokens(spark, sf):
    return views.chunks(spark, sf, False).select("chunk_id", F.size(X.tokens(F.col("content"))).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(X.tokens(F.col("content")))).cast("bigint").alias("n_terms"))


@query
def bm25_topk(spark, sf):
    return retrieval.bm25(views.chunks(spark, sf, False), views.queries(spark, sf, False), 10)


@query
def bm25_stored(spark, sf):
    """The stored index after three upserts and a deletion."""
    chunks = views.chunks(spark, sf, False).select("collection", "pdf_filename", "chunk_id", "content")
    index = bm25index.StoredBm25(spark, shared.scratch(spark, "bm25"))
    late = F.col("pdf_filename").isin("src1", "src2", "src3")
    index.upsert(chunks.withColumn("content", F.when(late, X.first_words(F.col("content"), 9)).otherwise(F.col("content"))))
    for name in ("src1", "src2", "src3"):
        index.upsert(chunks.filter(F.col("pdf_filename") == name))
    index.delete(chunks.filter("pdf_filename = 'src4' and collection = 'en'").select("collection", "pdf_filename").distinct())
    return index.search(views.queries(spark, sf, False), 10)


@query
def rule_keywords(spark, sf):
    q = views.queries(spark, sf, False)
    return q.select("query_id", F.array_join(retrieval.rule_keywords(F.col("query")), "|").alias("observed"), F.array_join(retrieval.rule_keywords(F.col("query"), "intended"), "|").alias("intended"))


@query
def keyword_search(spark, sf):
    return retrieval.keyword_search(_child(spark, sf), views.queries(spark, sf, False))


@query
def keyword_search_intended(spark, sf):
    return retrieval.keyword_search(_child(spark, sf), views.queries(spark, sf, False), "intended")


@query
def hybrid_merge(spark, sf):
    return retrieval.hybrid(_child(spark, sf), views.queries(spark, sf), 5)


@query
def rrf_three_way(spark, sf):
    c, q = views.chunks(spark, sf), views.queries(spark, sf)
    lexical = retrieval.ranked(retrieval.keyword_search(_child(spark, sf), q, "intended"), 50, "keyword_score", ["query_id"])
    return retrieval.fused([(retrieval.knn(c, q, 50), 1.0), (retrieval.bm25(c, q, 50), 1.0), (lexical, 1.0)], 20)


@query
def rrf_weighted(spark, sf):
    c, q = views.chunks(spark, sf), views.queries(spark, sf)
    return retrieval.fused([(retrieval.knn(c, q, 50), 0.7), (retrieval.bm25(c, q, 50), 0.3)], 10)


@query
def fused_pipeline(spark, sf):
    return retrieval.pipeline(views.chunks(spark, sf), views.queries(spark, sf))


@query
def routed_search_with_fallback(spark, sf):
    """Two documents' section for all queries, in a scope of three documents."""
    c, q = _child(spark, sf).filter("pdf_filename in ('src1', 'src2', 'src3')"), views.queries(spark, sf)
    to = F.explode(F.array(F.lit("src1"), F.lit("src2"))).alias("pdf_filename")
    return routing.sections_first(c, q, q.select("query_id", to, F.lit("Section 4").alias("toc_title")), 8)


@query
def routed_sections(spark, sf):
    """Each query has its own route; a third of them have none and ask the whole scope."""
    q = views.queries(spark, sf)
    turn = F.col("query_id") % 3
    routes = q.filter(turn > 0).select("query_id", F.concat(F.lit("src"), turn).alias("pdf_filename"), F.when(turn == 1, "Section 4").otherwise("Section 2").alias("toc_title"))
    return routing.sections_first(_child(spark, sf), q, routes, 8)


@query
def ask_collection(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(), 10)


@query
def ask_documents(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(chunk_type="child", documents=("src1", "src2", "no such")), 10)


@query
def ask_sections(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(chunk_type="child", documents=("src1",), sections=("Section 1", "Section 2")), 10)


@query
def ask_whole_sections(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(chunk_type="parent", documents=("src4",), sections=("Section 1",)), 10)


@query
def ask_pages(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(chunk_type="child", documents=("src2",), pages=(5, 20)), 10)


@query
def ask_whole_pages(spark, sf):
    return routing.ask(views.chunks(spark, sf), views.queries(spark, sf), Scope(chunk_type="parent", documents=("src4",), pages=(3, 9)), 10)


@query
def deleted_document(spark, sf):
    c = catalog.without_document(views.chunks(spark, sf, False), "en", "src2")
    return c.groupBy("collection", "pdf_filename").agg(F.count(F.lit(1)).alias("chunks"))


@query
def dropped_collection(spark, sf):
    return catalog.without_collection(views.chunks(spark, sf, False), "en").groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


@query
def full_pages(spark, sf):
    return pages.full_pages(views.chunks(spark, sf, False), "src4", 3, 9)


@query
def section_page_ranges(spark, sf):
    return pages.section_ranges(views.toc(spark, sf))


@query
def merged_intervals(spark, sf):
    return pages.merged(pages.section_ranges(views.toc(spark, sf)))


@query
def section_pages(spark, sf):
    toc = views.toc(spark, sf).withColumn("title", F.substring("title", 1, 9)).filter("pdf_filename = 'src5'")
    return pages.pages_of_sections(views.chunks(spark, sf, False), toc, ["Section 1"])


def _headed(spark, sf):
    """Blocks where most documents begin with a line of their source, spaced and cased in two ways."""
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The  Report of "), "pdf_filename")).otherwise(F.concat(F.lit(" the report OF "), "pdf_filename"))
    return views.blocks(spark, sf).withColumn("content", F.when((F.col("line") == 0) & (F.col("doc_id") % 10 < 8), line).otherwise(F.col("content")))


@query
def header_footer_patterns(spark, sf):
    return layout.running_lines(_headed(spark, sf))


@query
def header_footer_removal(spark, sf):
    b = _headed(spark, sf)
    return layout.without_running_lines(b, layout.running_lines(b)).groupBy("pdf_filename").agg(F.count(F.lit(1)).alias("blocks"))


@query
def block_types(spark, sf):
    return views.blocks(spark, sf).select("doc_id", "line", layout.block_type(F.col("content")).alias("block_type"))


@query
def block_type_counts(spark, sf):
    return layout.element_counts(views.blocks(spark, sf).select(layout.block_type(F.col("content")).alias("block_type")))


@query
def toc_asof(spark, sf):
    c = views.chunks(spark, sf, False).select("pdf_filename", "doc_id", "page_number")
    return layout.toc_links(c, views.toc(spark, sf)).select("doc_id", "toc_title", "toc_level", "toc_page")


@query
def toc_heading_jaccard(spark, sf):
    b = views.blocks(spark, sf).filter("line = 0")
    linked = layout.toc_links(b, views.toc(spark, sf))
    return linked.select("doc_id", F.round(X.jaccard(F.col("content"), F.col("toc_title")), 6).alias("likeness"), layout.is_toc_heading(layout.block_type(F.col("content")), F.col("content"), F.col("toc_title")).alias("is_toc_heading"))


@query
def sections(spark, sf):
    """Sections of each document's lines; the fold has no SQL form here."""
    b = views.blocks(spark, sf)
    rows = b.select(F.concat("pdf_filename", F.lit("/"), "doc_id").alias("pdf_filename"), F.col("line").alias("place"), "page_number", layout.block_type(F.col("content")).alias("block_type"), "content", F.lit(None).cast("string").alias("toc_title"))
    return chunking.sections(rows).select("pdf_filename", "section", "title", "page_number", "content")


@query
def sentences(spark, sf):
    s = views.chunks(spark, sf, False).select("doc_id", F.posexplode(X.sentences(F.col("content"))).alias("at", "sentence"))
    return s.select("doc_id", F.col("at").cast("bigint").alias("at"), "sentence", F.round(X.token_estimate(F.col("sentence")), 4).alias("tokens"))


@query
def child_chunks(spark, sf):
    return chunking.child_chunks(views.chunks(spark, sf, False))


@query
def parent_chunks(spark, sf):
    return chunking.parent_chunks(chunking.child_chunks(views.chunks(spark, sf, False)))


@query
def chunk_pages(spark, sf):
    return chunking.chunk_pages(chunking.child_chunks(views.chunks(spark, sf, False)), views.blocks(spark, sf))


def _children(spark, sf):
    """Every document is a section of its source."""
    c = views.chunks(spark, sf, False)
    sections = c.select("pdf_filename", F.col("doc_id").alias("section"), F.col("toc_title").alias("title"), "content", F.array("page_number").alias("pages"))
    return chunking.section_children(sections, views.blocks(spark, sf).withColumnRenamed("doc_id", "section"))


@query
def section_children(spark, sf):
    return _children(spark, sf).withColumn("page_numbers", F.array_join("page_numbers", ","))


@query
def section_parents(spark, sf):
    p = chunking.section_parents(_children(spark, sf))
    return p.withColumns({"page_numbers": F.array_join("page_numbers", ","), "child_ids": F.array_join("child_ids", ",")})


@query
def parent_lookup(spark, sf):
    children = _children(spark, sf)
    return catalog.parents_of(children, chunking.section_parents(children))


@query
def chunk_by_id(spark, sf):
    return views.chunks(spark, sf, False).filter("chunk_id = 'c17'").select("chunk_id", "collection", "pdf_filename", "page_number", "content")


@query
def document_overview(spark, sf):
    first = views.chunks(spark, sf, False).filter("pdf_filename = 'src6' and chunk_type = 'parent'")
    return first.orderBy("seq", "chunk_id").limit(5).select("chunk_id", "page_number")


@query
def history_recent_budget(spark, sf):
    return history.recent(views.turns(spark, sf), ["collection"], ["conv_id", "turn"]).select("collection", "conv_id", "turn", "total")


@query
def history_compaction(spark, sf):
    t = views.turns(spark, sf).withColumn("is_summary", (F.col("conv_id") % 37 == 5) & (F.col("turn") == 1))
    return history.compaction(t, ["collection"], ["conv_id", "turn"])


@query
def history_summarised(spark, sf):
    t = views.turns(spark, sf).withColumn("is_summary", (F.col("conv_id") % 37 == 5) & (F.col("turn") == 1))
    return history.summarised(t, ["collection"], ["conv_id", "turn"]).select("collection", "conv_id", "turn", "user_message", "is_summary", "is_summarized")


@query
def last_turns(spark, sf):
    return history.last_turns(views.turns(spark, sf), ["collection"], ["conv_id", "turn"], 15).select("collection", "conv_id", "turn")


@query
def history_display(spark, sf):
    return history.display(views.turns(spark, sf))


@query
def history_clear(spark, sf):
    t = views.turns(spark, sf).withColumn("is_cleared", F.lit(None).cast("boolean"))
    return history.visible(history.cleared(t, "c2")).groupBy("collection").agg(F.count(F.lit(1)).alias("turns"))


@query
def content_type_request(spark, sf):
    return views.turns(spark, sf).select("conv_id", "turn", history.content_request(F.col("user_message")).alias("request"))


@query
def question_complexity(spark, sf):
    return views.turns(spark, sf).select("conv_id", "turn", history.question_class(F.col("user_message")).alias("question_class"))


@query
def chunk_content_type(spark, sf):
    return views.chunks(spark, sf, False).select("chunk_id", history.chunk_content_type(F.lit("section"), F.col("toc_title"), F.col("content")).alias("content_type"))


@query
def content_type_filter(spark, sf):
    best = retrieval.bm25(views.chunks(spark, sf, False), views.queries(spark, sf, False), 10)
    c = views.chunks(spark, sf, False).select(F.col("chunk_id").alias("c"), history.chunk_content_type(F.lit("section"), F.col("toc_title"), F.col("content")).alias("kind"))
    return history.of_requested_type(best.join(c, F.col("chunk_id") == F.col("c")), F.col("kind") == "table").select("query_id", "chunk_id", "kind")


def _answers(spark, sf):
    d = views.chunks(spark, sf, False)
    first = X.first_words(F.regexp_replace("content", "[\"'<>]", ""), 6)
    quote = F.when(F.col("doc_id") % 2 == 0, '"').otherwise("'")
    parts = []
    for name, value in (("pdf_name", F.col("pdf_filename")), ("page_number", F.col("page_number").cast("string")), ("chunk_id", F.col("chunk_id")), ("cited_text", first)):
        parts += [F.lit(f" {name}="), quote, value, quote]
    return d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("As stated <citation"), *parts, F.lit("> here.")).alias("answer"))


@query
def citation_extract(spark, sf):
    return citations.extract(_answers(spark, sf))


@query
def citation_labels(spark, sf):
    c = citations.extract(_answers(spark, sf))
    return c.select("answer_id", citations.label(F.concat("pdf_name", F.lit(".pdf_of_"), "chunk_id", F.lit(".PDF"))).alias("label"), citations.tooltip(F.repeat("cited_text", (F.col("answer_id") % 5 + 1).cast("int"))).alias("tooltip"))


@query
def citation_locate(spark, sf):
    p = views.chunks(spark, sf, False)
    return citations.locate(citations.extract(_answers(spark, sf)), p)


def _grids(spark, sf):
    d = views.chunks(spark, sf, False).filter(F.contains("content", F.lit("|")))
    return d.select("doc_id", F.transform(F.filter(F.split("content", "\n"), lambda r: F.contains(r, F.lit("|"))), lambda r: F.split(r, r"\|")).alias("grid"))


@query
def table_clean(spark, sf):
    g = _grids(spark, sf).select("doc_id", layout.clean_grid(F.col("grid")).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("rows"), F.array_join(F.transform("g", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query
def table_markdown(spark, sf):
    return _grids(spark, sf).select("doc_id", layout.markdown(layout.clean_grid(F.col("grid"))).alias("markdown"))


@query
def context_pack(spark, sf):
    best = retrieval.bm25(views.chunks(spark, sf, False), views.queries(spark, sf, False), 8)
    asked = views.queries(spark, sf, False).select("query_id", F.concat(F.lit("c"), F.col("query_id") % 7).alias("collection"))
    return history.prompt_context(asked, best.join(views.chunks(spark, sf, False), "chunk_id"), views.turns(spark, sf), ["conv_id", "turn"])


@query
def budget_pack(spark, sf):
    best = retrieval.bm25(views.chunks(spark, sf, False), views.queries(spark, sf, False), 8)
    kind = history.chunk_content_type(F.lit("section"), F.col("toc_title"), F.col("content"))
    return history.within_budget(best.join(views.chunks(spark, sf, False), "chunk_id"), 2000.0, kind)


@query
def table_reformat(spark, sf):
    """All texts as tables; the bars of every third are those of its commas."""
    c, k = F.col("text"), F.col("doc_id") % 3
    return views.table(spark, sf, "documents").select("doc_id", history.table_text(F.when(k == 0, F.translate(c, ",", "|")).when(k == 1, F.regexp_replace(c, "[ie] ", "||")).otherwise(c)).alias("table"))


@query
def dedupe_sources(spark, sf):
    c, q = views.chunks(spark, sf), views.queries(spark, sf)
    both = retrieval.knn(c, q, 8).select("query_id", "chunk_id", F.lit(1).alias("answer"), "rank").unionByName(retrieval.bm25(c, q, 8).select("query_id", "chunk_id", F.lit(2).alias("answer"), "rank"))
    return history.distinct_sources(both).select("query_id", "chunk_id", F.col("answer").cast("bigint").alias("answer"), "rank")


def _files(spark, sf):
    return views.table(spark, sf, "documents").select(F.col("lang").alias("collection"), F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("pdf_filename"), "doc_id")


def _ledger(spark, sf):
    labels = views.table(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    known = _files(spark, sf).join(labels, F.col("doc_id") == F.col("l"))
    return known.select(F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("collection")).alias("collection"), "pdf_filename")


@query
def collection_from_path(spark, sf):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "/data/pdfs/").when(F.col("doc_id") % 3 == 1, "/data/pdfs/My Books-").otherwise("/data/other/"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.upper("collection"), F.lit("/"))).otherwise(""), "pdf_filename")
    return _files(spark, sf).select("doc_id", catalog.collection_of_path(path).alias("collection"))


@query
def new_files(spark, sf):
    return catalog.new_files(_files(spark, sf), _ledger(spark, sf)).select("collection", "pdf_filename")


@query
def moved_files(spark, sf):
    return catalog.moved_files(_files(spark, sf), _ledger(spark, sf))


@query
def orphan_files(spark, sf):
    return catalog.orphans(_ledger(spark, sf), _files(spark, sf).filter("doc_id % 11 <> 0"))


@query
def batch_outcomes(spark, sf):
    done = _ledger(spark, sf).select("collection", "pdf_filename", F.lit(1).alias("done"))
    return catalog.outcomes(_files(spark, sf).join(done, ["collection", "pdf_filename"], "left").withColumn("status", F.when(F.col("done") == 1, "skipped").otherwise("processed")))


@query
def upserted_chunks(spark, sf):
    stored = views.chunks(spark, sf, False).select("collection", "pdf_filename", "chunk_id", "content")
    fresh = stored.filter("pdf_filename in ('src1', 'src7')").select("collection", "pdf_filename", F.concat(F.lit("n"), "chunk_id").alias("chunk_id"), F.when(F.length("content") % 2 == 0, " ").otherwise(F.col("content")).alias("content"))
    return catalog.upserted(stored, fresh).groupBy("collection", "pdf_filename").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_id").startswith("n")).alias("fresh"))


@query
def paragraph_positions(spark, sf):
    """Every second document has its lines parted by empty ones; those of the others are joined by the line rules."""
    c = F.col("content")
    p = views.chunks(spark, sf, False).select("pdf_filename", F.col("doc_id").alias("page_number"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(c, "\n", "\n\n")).otherwise(c).alias("content"))
    return layout.paragraph_positions(p)


@query
def toc_page_signals(spark, sf):
    return views.chunks(spark, sf, False).select("doc_id", layout.toc_page_signals(F.col("content")).cast("bigint").alias("signals"))


@query
def html_paragraphs(spark, sf):
    p = views.table(spark, sf, "pages")
    parts = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<(?:p|h1)>(.*?)</(?:p|h1)>"), F.lit(1))).alias("at", "text"))
    return parts.select("page_id", F.col("at").cast("bigint").alias("at"), X.squashed(F.regexp_replace("text", "<[^>]*>", " ")).alias("text"))


@query
def valid_names(spark, sf):
    asked = views.table(spark, sf, "benchmark").select(F.concat(F.lit("src"), F.col("item_id")).alias("pdf_filename"))
    return catalog.valid_names(asked, views.chunks(spark, sf, False))


@query
def best_path(spark, sf):
    wanted = _files(spark, sf).select("collection", "pdf_filename")
    folder = F.when(F.col("doc_id") % 4 == 0, F.col("collection")).when(F.col("doc_id") % 4 == 1, F.upper("collection")).when(F.col("doc_id") % 4 == 2, F.lit("elsewhere")).otherwise(F.lit("pdfs"))
    one = _files(spark, sf).select(F.concat(F.lit("/data/"), folder, F.lit("/"), "pdf_filename").alias("path"), "pdf_filename")
    two = _files(spark, sf).filter("doc_id % 3 = 0").select(F.concat(F.lit("/data/pdfs/"), "pdf_filename").alias("path"), "pdf_filename")
    return catalog.best_path(wanted, one.unionByName(two).distinct())


@query
def figure_gate(spark, sf):
    c = views.chunks(spark, sf, False)
    boxes = c.select("pdf_filename", "page_number", F.col("chunk_id").alias("box_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("doc_id") % 60 * 10.0).alias("x1"), (F.length("content") % 700 * 1.0).alias("y1"))
    return layout.worth_analysing(boxes).select("pdf_filename", "box_id", "area_share", "place")


@query
def toc_continuation(spark, sf):
    return views.chunks(spark, sf, False).select("doc_id", layout.continues_toc(F.col("content")).alias("continues"))


@query
def page_range_parse(spark, sf):
    t = F.concat(F.col("doc_id") % 17, F.when(F.col("doc_id") % 5 == 0, "x").otherwise("-"), F.col("doc_id") % 13)
    return views.chunks(spark, sf, False).select("doc_id", pages.parsed_range(t).alias("r")).select("doc_id", F.coalesce("r.first", F.lit(-1)).alias("first"), F.coalesce("r.last", F.lit(-1)).alias("last"))


@query
def file_sizes(spark, sf):
    return views.chunks(spark, sf, False).select("doc_id", pages.file_size(F.length("content").cast("bigint") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1000000)).alias("size"))


@query
def caption_titles(spark, sf):
    caption = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Figure "), F.col("doc_id"), F.lit(": "), X.first_words(F.col("content"), 4))).when(F.col("doc_id") % 4 == 1, X.first_words(F.col("content"), 4)).when(F.col("doc_id") % 4 == 2, "")
    return views.chunks(spark, sf, False).select("doc_id", chunking.caption_title(caption, F.lit("figure"), F.col("page_number")).alias("title"))


@query
def column_geometry(spark, sf):
    spans = views.chunks(spark, sf, False).select("pdf_filename", "page_number", (F.length("content") % 23 * 25.0).alias("x0"))
    return layout.column_gaps(spans).select("pdf_filename", "page_number", "column_count", F.size("gaps").cast("bigint").alias("n_gaps"), F.coalesce(F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("total_gap"))


@query
def span_lines(spark, sf):
    spans = views.chunks(spark, sf, False).select("pdf_filename", (F.col("page_number") % 4).alias("page_number"), "doc_id", (F.col("doc_id") * 7 % 101 * 3.0).alias("y0"), F.col("doc_id").cast("double").alias("x0"))
    return layout.lines_of_spans(spans).select("doc_id", F.col("line").cast("bigint").alias("line"))


@query
def guessed_titles(spark, sf):
    b = views.blocks(spark, sf).select(F.col("doc_id").cast("string").alias("pdf_filename"), (F.col("line") + 1).alias("place"), "content", F.when(F.col("line") % 2 == 0, 12.0).otherwise(14.0).alias("font_size"), F.when(F.col("line") % 3 < 2, "heading").otherwise("paragraph").alias("block_type"))
    return chunking.guessed_title(b)


@query
def answer_choice(spark, sf):
    from marginalia.sources import providers

    t = views.turns(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.explode(F.array(F.struct(F.lit(1).alias("answer"), F.col("user_message").alias("text"), F.when(F.col("conv_id") % 2 == 0, "medium").otherwise("low").alias("confidence")), F.struct(F.lit(2).alias("answer"), F.col("assistant_response").alias("text"), F.when(F.col("turn") % 4 == 1, "High").otherwise("low").alias("confidence")))).alias("a")).select("query_id", "a.*")
    return providers.pick_by_confidence(t)


@query
def toc_title_spans(spark, sf):
    d, c = views.table(spark, sf, "documents"), F.col("text")
    title = F.when(F.col("doc_id") % 4 == 0, X.first_words(c, 6)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("zzq "), X.first_words(c, 6), F.lit(" qqz"))).when(F.col("doc_id") % 4 == 2, F.translate(X.first_words(c, 2), string.ascii_lowercase, string.ascii_uppercase)).otherwise(F.concat(X.first_words(c, 1), F.lit(" qx vz Report kq")))
    titles = d.select(F.col("source").alias("pdf_filename"), F.col("doc_id").alias("title_id"), title.alias("title"))
    spans = views.blocks(spark, sf).select("pdf_filename", F.struct("page_number", "doc_id", "line").alias("place"), "content")
    return matching.title_spans(titles, spans).select("pdf_filename", "title_id", "place.page_number", "place.doc_id", "place.line", "rule")


def _boxes(spark, sf, *, x: int, y: int, left: int, top: int, wide: int, least: int, high: int):
    """A box for each document, on one of five pages of its source."""
    c, n = F.col, F.coalesce(F.length("text"), F.lit(0))
    x0, y0 = left + c("doc_id") * x % 320, top + c("doc_id") * y % 600
    sides = {"x0": x0, "y0": y0, "x1": x0 + least + n % wide, "y1": y0 + high}
    return views.table(spark, sf, "documents").select(c("source").alias("pdf_filename"), (F.floor(c("doc_id") / 20) % 5 + 1).cast("bigint").alias("page_number"), "doc_id", n.alias("n"), *(v.cast("double").alias(k) for k, v in sides.items()))


@query
def toc_link_targets(spark, sf):
    sides = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    entries = _boxes(spark, sf, x=37, y=53, left=72, top=72, wide=200, least=20, high=12).select("pdf_filename", "page_number", F.col("doc_id").alias("entry_id"), sides)
    links = _boxes(spark, sf, x=91, y=29, left=60, top=70, wide=90, least=15, high=10).select("pdf_filename", "page_number", F.col("doc_id").alias("ord"), sides, (F.col("n") % 40 + 1).cast("bigint").alias("dest_page"))
    return spatial.link_targets(entries, links)


@query
def box_captions(spark, sf):
    boxes = _boxes(spark, sf, x=37, y=53, left=72, top=72, wide=200, least=20, high=60).withColumnRenamed("doc_id", "box_id").withColumn("kind", F.when(F.col("box_id") % 3 == 0, "table").otherwise("figure"))
    c = F.col
    spans = views.blocks(spark, sf).select(
        "pdf_filename", (F.floor(c("doc_id") / 20) % 5 + 1).cast("bigint").alias("page_number"), (40.0 + (c("doc_id") * 37 + c("line") * 11) % 500).alias("x0"), (40.0 + (c("line") * 13 + c("doc_id") * 7) % 700).alias("y0"),
        F.when((c("doc_id") + c("line")) % 5 == 0, F.concat(F.lit("Figure "), c("line"), F.lit(": "), c("content"))).otherwise(c("content")).alias("content"),
    )
    return spatial.captions(boxes, spans)


@query
def table_fallback(spark, sf):
    """Every word is a span of its document's region; lines are rows, some of them a few points apart only."""
    words = views.blocks(spark, sf).select("pdf_filename", "doc_id", "line", F.posexplode(X.words(F.col("content"))).alias("k", "content"))
    x0, y0 = 50.0 + F.col("k") * 60.0, 72.0 + F.col("line") * 12.0 - F.when(F.col("line") % 4 == 3, 6.0).otherwise(0.0) + F.col("k") % 3 * 2.0
    spans = words.select("pdf_filename", F.lit(1).alias("page_number"), F.col("doc_id").alias("region"), "content", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("content") * 6.0).alias("x1"))
    g = spatial.table_grids(spans)
    return g.select("region", F.size("grid").cast("bigint").alias("n_rows"), F.size(F.get("grid", F.lit(0))).cast("bigint").alias("n_columns"), F.md5(F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "~")).alias("digest"))


@query
def json_answers(spark, sf):
    """Every text as a model's answer: whole, fenced, nested, with keys missing or null, broken, and with something after its end."""
    c, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 8
    given = F.to_json(F.struct(F.lit(False).alias("found_answer"), F.lit("high").alias("confidence"), c.alias("response")))
    few = F.to_json(F.struct(c.alias("response")))
    first = X.first_words(F.translate(c, '"\\', ""), 3)
    made = (
        F.when(k == 0, given).when(k == 1, F.concat(F.lit(" ```json\n"), given, F.lit("\n``` "))).when(k == 2, F.concat(F.lit("```"), few, F.lit("```"))).when(k == 3, F.concat(F.lit("json "), few, F.lit("\\\\ \n")))
        .when(k == 4, F.concat(F.lit('`{"response": {"parts": ["'), first, F.lit('"]}, "confidence": null}`'))).when(k == 5, F.concat(F.lit('{"response": "'), first)).when(k == 6, F.concat(given, F.lit(" and more"))).otherwise(first)
    )
    a = answers.answer(answers.unfenced(made))
    return views.table(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.*")


@query
def page_text_hits(spark, sf):
    """A part of every document sought on its own page and those beside it, as it is and normalised; lines are spans."""
    page = F.floor(F.col("doc_id") / 20).cast("bigint").alias("page_number")
    spans = views.blocks(spark, sf).select("pdf_filename", page, F.col("line").alias("ord"), "content")
    wanted = views.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("pdf_filename"), page, F.substring("text", 20, 60).alias("text"))
    each = [pagesearch.hits(spans, wanted, plain).withColumn("mode", F.lit(name)) for name, plain in (("exact", False), ("normalised", True))]
    return each[0].unionByName(each[1]).select("query_id", "mode", "page_number", F.col("place").cast("bigint").alias("place"), "ord")


def _spans(spark, sf):
    """Each document set in two columns of forty lines of up to twelve words, its last lines on a page in small print."""
    c, lines = F.col, F.transform(F.split("text", "\n"), X.words)
    cut = F.flatten(F.transform(lines, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(12)), lambda i: F.array_join(F.slice(w, i + 1, 12), " "))))
    s = views.table(spark, sf, "documents").select("doc_id", F.posexplode(cut).alias("u", "content")).withColumn("u", c("u").cast("bigint")).withColumn("row", c("u") % 40)
    x0, y0 = 50.0 + F.floor(c("u") / 40) % 2 * 300 + c("u") % 3 * 4, 72.0 + c("row") * 14 + F.floor(c("row") / 5) * (c("doc_id") % 2 * 12)
    return s.select(
        c("doc_id").cast("string").alias("pdf_filename"), (F.floor(c("u") / 80) + 1).alias("page_number"), c("u").alias("ord"), "content", x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 10).alias("y1"),
        F.concat(F.lit("F"), c("u") * c("u") % 5).alias("font_name"), F.when(c("row") >= 36, 8.0).when(c("u") % 11 == 0, 15.0).otherwise(12.0).alias("font_size"), F.when(c("u") % 9 == 0, "bold").alias("font_weight"),
    )


@query
def span_paragraphs(spark, sf):
    return paragraphs.span_paragraphs(_spans(spark, sf)).withColumn("font_size", F.round("font_size", 6))


def _disk(spark, sf, folder, there):
    """A file for each document, in a folder of its language or another one."""
    d = views.table(spark, sf, "documents").filter(there).select(F.concat(F.lit("/data/pdfs/"), folder, F.lit("/f"), "doc_id", F.lit(".pdf")).alias("path"))
    return d.select(catalog.collection_of_path(F.col("path")).alias("collection"), F.element_at(F.split("path", "/"), -1).alias("pdf_filename"), "path")


@query
def batch_driver(spark, sf):
    """Two batches of files, some of which fail; before the second one files come, go and move. What became of each, and what is stored."""
    language, k = F.coalesce("lang", F.lit("none")), F.col("doc_id")
    store = batch.ChunkStore(spark, shared.scratch(spark, "batch"), "collection STRING, pdf_filename STRING, chunk_id STRING, content STRING")

    def chunker(broken):
        texts = views.table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("pdf_filename"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("text").alias("content"), F.when(k % 13 == broken, "unreadable").alias("error"))
        return lambda files: files.join(texts, "pdf_filename")

    store.run(_disk(spark, sf, language, k % 11 != 0), chunker(5))
    store.run(_disk(spark, sf, F.when(k % 7 == 0, "old").otherwise(language), k % 5 != 1), chunker(6))
    became = store.table("outcomes").groupBy("gen", "collection", "status", "reason").agg(F.count(F.lit(1)).alias("documents"), F.lit(0).cast("bigint").alias("characters"))
    holds = store.chunks().groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("content")).alias("characters"))
    return became.unionByName(holds.select(F.lit(2).alias("gen"), "collection", F.lit("stored").alias("status"), F.lit(None).cast("string").alias("reason"), "documents", "characters"))


@query
def content_blocks(spark, sf):
    """Every line of every document is an element: of seven one is a table, one a figure, one a footnote, the others paragraphs."""
    turn, k = (F.col("doc_id") + F.col("line")) % 7, F.col("doc_id")
    b = views.blocks(spark, sf).withColumns({"ord": k * 100000 + F.col("line"), "turn": turn, "x0": F.lit(100.0) + k % 5 * 10, "y1": F.col("y0") + 10.0, "words": X.words(F.col("content"))})
    b = b.withColumn("x1", F.col("x0") + 200.0)
    grid = F.filter(F.array(F.slice("words", 1, 3), F.slice("words", 4, 3)), lambda r: F.size(r) > 0)
    tables = b.filter("turn = 3").withColumn("grid", grid).withColumns({"markdown": F.when(k % 2 == 0, layout.markdown(F.col("grid"))), "caption": F.concat(F.lit("Table "), "line")})
    figures = b.filter("turn = 5").withColumns({"caption": F.when(k % 3 > 0, X.first_words(F.col("content"), 6)), "image_type": F.lit("png")})
    notes = b.filter("turn = 6").withColumn("reference_number", F.col("line").cast("string"))
    return elements.content_blocks(b.filter("turn not in (3, 5, 6)"), tables, figures, notes, views.toc(spark, sf)).fillna(0, ["row_count", "column_count", "width", "height"])


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return fused_pipeline(spark, sf)
