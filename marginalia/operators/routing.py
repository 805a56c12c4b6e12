"""Which chunks a question is asked of: routed sections with their fallback, and the search that a scope's mode calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import catalog, pages, retrieval
from marginalia.operators.catalog import Scope
from marginalia.sources.providers import Providers

#: Results that routed sections give at least, or the whole scope fills up; pages of a range beyond which it is searched.
FEWEST = 3


def routed_hybrid(chunks: DataFrame, queries: DataFrame, routes: DataFrame, n: int) -> DataFrame:
    """As `hybrid`, each query over the chunks of its own routes (query_id, pdf_filename, toc_title): met by equality."""
    asked = routes.select("query_id", "pdf_filename", "toc_title").distinct().join(queries, "query_id")
    pairs = chunks.join(asked, ["pdf_filename", "toc_title"])
    near = pairs.filter("embedding is not null").select("query_id", "chunk_id", F.round(retrieval.squared_distance(F.col("embedding"), F.col("vector")), 10).alias("distance"))
    worded = pairs.select("query_id", "chunk_id", "content", F.lower("content").alias("low"), retrieval.rule_keywords(F.col("query")).alias("keywords"))
    worded = worded.filter(F.exists("keywords", lambda w: F.contains(F.col("low"), F.lower(w))))
    score = F.aggregate(F.transform("keywords", lambda w, i: retrieval.keyword_weight(F.col("content"), w, i)), F.lit(0.0), lambda s, x: s + x)
    lexical = worded.select("query_id", "chunk_id", F.least(F.round(score, 6), F.lit(1.0)).alias("similarity"))
    return retrieval.merged(retrieval.ranked(near, 2 * n, "distance", ["query_id"], ascending=True), lexical, n)


def sections_first(chunks: DataFrame, queries: DataFrame, routes: DataFrame, n: int) -> DataFrame:
    """Each query's routed sections; where they give fewer than max(3, n / 2) results, the whole scope fills up, and a query
    without a route asks the whole scope."""
    routed = routed_hybrid(chunks, queries, routes, n).select("query_id", "chunk_id", "score", "source_type", F.lit(0).alias("stage"), "rank")
    known = routes.select("query_id").distinct()
    few = queries.select("query_id").join(known, "query_id").join(routed.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")), "query_id", "left")
    short = few.withColumn("found", F.coalesce("found", F.lit(0))).filter(F.col("found") < max(FEWEST, n // 2))
    wide = retrieval.hybrid(chunks, queries, 2 * n)
    fresh = wide.join(short, "query_id").filter(F.col("rank") <= 2 * (n - F.col("found"))).join(routed.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fresh = retrieval.ranked(fresh.withColumn("place", F.col("rank")), None, "place", ["query_id"], name="turn", ascending=True).filter(F.col("turn") <= n - F.col("found"))
    fresh = fresh.select("query_id", "chunk_id", "score", F.lit("global_fallback").alias("source_type"), F.lit(1).alias("stage"), F.col("place").alias("rank"))
    plain = wide.filter(F.col("rank") <= n).join(known, "query_id", "left_anti").select("query_id", "chunk_id", "score", "source_type", F.lit(0).alias("stage"), "rank")
    return retrieval.ranked(routed.unionByName(fresh).unionByName(plain).drop("rank"), None, "score", ["query_id"]).drop("stage")


def valid_documents(chunks: DataFrame, scope: Scope) -> Scope:
    """The scope with those of its documents that the collection has; it is looked at once."""
    if not scope.documents:
        return scope
    there = {r.pdf_filename for r in chunks.filter(F.col("pdf_filename").isin(*scope.documents)).select("pdf_filename").distinct().collect()}
    return Scope(scope.chunk_type, tuple(d for d in scope.documents if d in there), scope.sections, scope.pages, scope.partial_titles)


def section_pages(chunks: DataFrame, scope: Scope) -> DataFrame:
    """(chunk_id, score, rank): the whole pages of the scope's sections in its documents, at most as many as a prompt takes; else no rows."""
    mine = chunks.filter(F.col("pdf_filename").isin(*scope.documents)) if scope.documents else chunks
    found = pages.pages_of_sections(mine, catalog.sections_of_documents(mine).withColumnRenamed("page", "page_number"), list(scope.sections))
    place = F.row_number().over(Window.orderBy("pdf_filename", "page_number", "content"))  # the rows of ten pages at most
    return found.select(F.concat("pdf_filename", F.lit(":page:"), "page_number").alias("chunk_id"), F.lit(1.0).alias("score"), place.alias("rank"))


def ask(chunks: DataFrame, queries: DataFrame, scope: Scope, n: int = 10, providers: Providers | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for a batch of questions, by the scope's mode.

    page_range: the whole pages where parent chunks are asked for and the range is small enough, else nearest chunks of the range.
    toc_section: the whole pages of the sections where parent chunks are asked for and they are few enough, else semantic and keyword results
    of chunks with these titles. pdf and group: semantic and keyword results of the documents. collection: the fused
    lists, reranked. Routes of `providers` come first for documents and the collection; its `expand` rewrites the questions. A scope
    of documents that the collection has none of gives no rows.
    """
    providers = providers or Providers()
    known = valid_documents(chunks, scope)
    asked = providers.expand(queries)
    own = chunks.filter(known.condition()) if not scope.documents or known.documents else chunks.limit(0)
    if known.pages and scope.chunk_type == "parent" and known.documents:
        whole = pages.full_pages(chunks, known.documents[0], *known.pages)
        if whole.take(1):
            return queries.select("query_id").join(F.broadcast(whole.select(F.col("id").alias("chunk_id"), "score", "rank")))
    if known.mode == "toc_section":
        if scope.chunk_type == "parent":
            whole = section_pages(chunks, known)
            if whole.take(1):
                return queries.select("query_id").join(F.broadcast(whole))
        return retrieval.hybrid(own, asked, n).select("query_id", "chunk_id", "score", "rank")
    if known.mode == "page_range":
        return retrieval.knn(own, asked, n).select("query_id", "chunk_id", F.round(1.0 - F.col("distance"), 6).alias("score"), "rank")
    if providers.routes:
        rows = [(q, d, t) for q, per in providers.routes.items() for d, titles in per.items() for t in titles]
        routes = chunks.sparkSession.createDataFrame(rows, "query_id bigint, pdf_filename string, toc_title string")
        return sections_first(own, asked, routes, n).select("query_id", "chunk_id", "score", "rank")
    if known.mode == "collection":
        return retrieval.pipeline(own, asked, n, rerank=providers.rerank).select("query_id", "chunk_id", "score", "rank")
    return retrieval.hybrid(own, asked, n).select("query_id", "chunk_id", "score", "rank")
