"""Exact vector search, BM25, keyword scoring and rank fusion, for batches of queries.

A batch of queries is packed into a few rows and met with every chunk block by block; the packed side
is broadcast only where its size is known to be small. Top-k is a window rank, which Spark cuts to k
rows in each task before it shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lists
from marginalia.functions import text as X

#: Queries in one packed row, and most packed rows that are broadcast.
PACK, MOST_PACKS = 64, 2048
#: Most rows of asked terms that are broadcast.
MOST_TERMS = 1 << 18


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def half_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(2.0) - distance) / 2.0)


def packed(queries: DataFrame, columns: list[str]) -> DataFrame:
    """(pack, queries): the queries in arrays of about PACK, broadcast if there are few."""
    rows = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(queries.count() / PACK)))).alias("pack")).agg(F.collect_list(F.struct(*columns)).alias("queries"))
    return F.broadcast(rows) if rows.limit(MOST_PACKS + 1).count() <= MOST_PACKS else rows


def ranked(df: DataFrame, k: int | None, score: str, by: list[str], tie: str = "chunk_id", name: str = "rank", ascending: bool = False) -> DataFrame:
    """Adds the rank by score within `by`, ties by `tie`, and keeps k of each."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))
    return out if k is None else out.filter(F.col(name) <= k)


def knn(chunks: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(query_id, *by, chunk_id, distance, rank): the k chunks with the least squared distance, rounded to so many digits; a chunk without a vector is none."""
    pairs = chunks.filter("embedding is not null").select(*by, "chunk_id", "embedding").join(packed(queries, ["query_id", "vector"]))
    each = pairs.select(*by, "chunk_id", F.explode(F.transform("queries", lambda q: F.struct(q["query_id"].alias("query_id"), F.round(squared_distance(F.col("embedding"), q["vector"]), digits).alias("distance")))).alias("q"))
    return ranked(each.select("q.query_id", *by, "chunk_id", "q.distance"), k, "distance", ["query_id", *by], ascending=True)


def term_postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, length)."""
    words = chunks.select("chunk_id", X.tokens(F.col("content")).alias("t")).select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return words.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def few(rows: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """The rows, or what is made of them, broadcast if there are at most MOST_TERMS."""
    made = rows if made is None else made
    return F.broadcast(made) if rows.limit(MOST_TERMS + 1).count() <= MOST_TERMS else made


def term_scores(postings: DataFrame, asked: DataFrame, weights: DataFrame, mean_length: float, by: list[str], k1: float, b: float) -> DataFrame:
    """(query_id, *by, score) of postings (*by, term, tf, length) dealt by chunk_id, which is of `by`: few asked terms are broadcast, so that a chunk's
    postings and scores stay where they are and no common term is one task's."""
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("length") / mean_length))
    return postings.join(few(asked, asked.join(weights, "term")), "term").groupBy("query_id", *by).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, chunk_id, score, rank). A term in more than half of the chunks weighs `floor` times the mean weight of all terms.

    Terms that no query asks are only counted, each chunk's once before they are shuffled. Where a chunk_id repeats, its rows of one length are one chunk.
    """
    rows = chunks.select("chunk_id", X.tokens(F.col("content")).alias("t")).select("chunk_id", F.size("t").alias("length"), "t", F.lit(1).alias("rows"))
    if chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("chunk_id", "length").agg(F.flatten(F.collect_list("t")).alias("t"), F.count(F.lit(1)).alias("rows"))
    # Each chunk's terms are counted once, and in the same pass, as a null term, the chunks and their lengths.
    words = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")))
    found = rows.select("rows", "length", F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("length")).alias("tokens"), F.sum(F.when(F.col("length").isNotNull(), F.col("rows"))).alias("sized"))
    # How many terms so many chunks hold: as many rows as counts that differ, at most the root of twice the postings.
    size = F.max(F.when(F.col("term").isNull(), F.struct("rows", "tokens", "sized"))).alias("size")
    held = found.groupBy("df").agg(F.count("term").alias("terms"), size).collect()
    n, tokens, sized = next((r.size for r in held if r.size), (0, None, 0))
    n, mean_length = float(n), tokens / sized if tokens and sized else 0.0
    mean = math.fsum(r.terms * (math.log(n - r.df + 0.5) - math.log(r.df + 0.5)) for r in held if r.terms) / (sum(r.terms for r in held) or 1)
    asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    dealt = rows.select("chunk_id", "length", F.explode("t").alias("term")).join(few(asked.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    postings = dealt.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")).select("term", F.when(F.col("raw") < 0, floor * mean).otherwise(F.col("raw")).alias("idf"))
    return ranked(term_scores(postings, asked, weights, mean_length, ["chunk_id"], k1, b), k, "score", ["query_id"])


def rule_keywords(query: Column, mode: str = "observed") -> Column:
    """The whole query if it has several words, its quoted phrases and, in mode "intended", its specific words first after it."""
    whole = X.stripped(query)
    several = F.size(X.words(whole)) > 1
    parts = [F.when(several, F.array(whole)).otherwise(F.array().cast("array<string>"))]
    stop = F.array(*map(F.lit, lists.QUERY_STOP_WORDS))
    if mode == "intended":
        parts.append(F.filter(X.tokens(whole), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 4)))
    parts.append(F.regexp_extract_all(whole, F.lit('"([^"]*)"'), F.lit(1)))
    keep = lambda w: (F.size(X.words(w)) > 1) | ((F.length(w) > 4) & ~F.array_contains(stop, F.lower(w)))
    return F.array_distinct(F.filter(F.concat(*parts), keep))


def keyword_weight(content: Column, keyword: Column, place: Column, low: Column | None = None) -> Column:
    """What one keyword adds to the score of a text that holds it in any case, else 0; `low` is the lowered text, if it is there already."""
    low, key = F.lower(content) if low is None else low, F.lower(keyword)
    n = X.occurrences(low, key)
    general = F.array(*map(F.lit, lists.SCORING_STOP_WORDS))
    kind = F.when(F.size(X.words(keyword)) > 1, 3.0).when(F.array_contains(general, key), 0.1).when(F.length(keyword) <= 4, 0.3).otherwise(1.0)
    cased = F.when(F.contains(content, keyword), 1.5).otherwise(1.0)
    rare = F.when(n <= 2, 1.5).when(n > 20, 0.7).otherwise(1.0)
    return F.when(F.contains(low, key), F.lit(1.0) / (place + 1) * kind * cased * rare * n).otherwise(0.0)


def keyword_search(chunks: DataFrame, queries: DataFrame, mode: str = "observed") -> DataFrame:
    """(query_id, chunk_id, keyword_score, similarity, matched_keywords): chunks that hold a keyword of the query at least.

    A text that holds a keyword has the longest of the keyword's words in one of its own, so each distinct word of all texts is held against these
    longest words once, and chunks meet only queries that have one of them in the chunk.
    """
    asked = queries.select("query_id", rule_keywords(F.col("query"), mode).alias("keywords")).filter(F.size("keywords") > 0)
    # Texts and keywords are lowered once each, before they meet.
    asked = asked.withColumn("low", F.transform("keywords", lambda w: F.lower(w)))
    texts = chunks.select("chunk_id", "content", F.lower("content").alias("low"))
    # Words stand between white space of any kind here; keywords without a word, as quoted blanks are, have the empty one.
    longest = F.array_max(F.transform(X.words(F.col("key")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    sought = asked.select("query_id", F.explode("low").alias("key")).select("query_id", F.coalesce(longest, F.lit("")).alias("word")).distinct()
    held = texts.select("chunk_id", F.explode(F.array_distinct(F.array_append(X.words(F.col("low")), F.lit("")))).alias("token"))
    packs = packed(sought.select("word").distinct().withColumn("query_id", F.col("word")), ["word"])
    known = held.select("token").distinct().join(packs).select("token", F.explode(F.filter("queries", lambda q: F.contains(F.col("token"), q["word"]))).alias("q"))
    # The words of a query are many to one token at most, so a chunk's queries are told apart before they meet its text.
    tokens = known.select("token", "q.word").join(sought, "word").groupBy("token").agg(F.collect_set(F.struct("query_id")).alias("ids"))
    met = held.join(tokens, "token").select("chunk_id", F.explode("ids").alias("id")).select("chunk_id", F.col("id.query_id").alias("id")).distinct()
    met = met.join(asked, F.col("id").eqNullSafe(F.col("query_id"))).groupBy(F.col("chunk_id").alias("_c")).agg(F.collect_list(F.struct("query_id", "keywords", F.col("low").alias("keys"))).alias("queries"))
    pairs = texts.join(met, F.col("chunk_id").eqNullSafe(F.col("_c")))
    hit = pairs.select("chunk_id", "content", "low", F.explode(F.filter("queries", lambda q: F.exists(q["keys"], lambda w: F.contains(F.col("low"), w)))).alias("q"))
    score = F.aggregate(F.transform(F.col("q.keywords"), lambda w, i: keyword_weight(F.col("content"), w, i, F.col("low"))), F.lit(0.0), lambda s, x: s + x)
    matched = F.filter(F.col("q.keywords"), lambda w, i: F.contains(F.col("low"), F.get("q.keys", i)))
    return hit.select("q.query_id", "chunk_id", F.round(score, 6).alias("keyword_score"), F.array_join(matched, "|").alias("matched_keywords")).withColumn("similarity", F.least(F.col("keyword_score"), F.lit(1.0)))


def hybrid(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Semantic top 2n merged with all keyword matches; the best n of each query."""
    return merged(knn(chunks, queries, 2 * n, digits=10), keyword_search(chunks, queries), n)


def merged(near: DataFrame, lexical: DataFrame, n: int) -> DataFrame:
    """Nearest chunks (query_id, chunk_id, distance, rank) and keyword matches (query_id, chunk_id, similarity) in one list of n."""
    semantic = near.select("query_id", "chunk_id", F.round(half_similarity(F.col("distance")), 6).alias("semantic"), F.col("rank").alias("place"))
    lexical = lexical.select("query_id", "chunk_id", "similarity")
    both = semantic.join(lexical, ["query_id", "chunk_id"], "full_outer")
    score = F.when(F.col("semantic").isNull(), F.col("similarity")).when(F.col("similarity").isNull(), F.col("semantic")).otherwise(F.least(F.lit(1.0), F.col("semantic") + 0.1))
    out = both.select(
        "query_id", "chunk_id", F.round(score, 6).alias("score"), F.when(F.col("semantic").isNull(), "keyword_match").otherwise("semantic").alias("source_type"),
        (F.col("semantic").isNotNull() & F.col("similarity").isNotNull()).alias("keyword_boost"), F.coalesce("place", F.lit(1 << 30)).alias("place"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("place")


def fused(lists_: list[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank) lists, each with a weight: a union and a sum."""
    parts = None
    for ranks, weight in lists_:
        part = ranks.select("query_id", "chunk_id", (F.lit(float(weight)) / (constant + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return ranked(parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 8).alias("score")), k, "score", ["query_id"])


def pipeline(chunks: DataFrame, queries: DataFrame, top_k: int = 10, depth: int = 50, pool: int = 20, rerank=None) -> DataFrame:
    """Dense, BM25 and keyword lists of `depth`, fused; the best `pool` go to the reranker and `top_k` stay. Keywords look at child chunks only."""
    lexical = ranked(keyword_search(chunks.filter("chunk_type = 'child'"), queries), depth, "keyword_score", ["query_id"])
    best = fused([(knn(chunks, queries, depth), 1.0), (bm25(chunks, queries, depth), 1.0), (lexical, 1.0)], pool)
    return (rerank(best) if rerank else best).filter(F.col("rank") <= top_k)
