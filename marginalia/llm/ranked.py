"""Ranked lexical search by branch and bound over max trees.

Documents lie in ranges of a few thousand as they are stored (a row of the index each). In a range every asked term has a tree
of maxima: of blocks of `FAN` documents, of `FAN` blocks, and so on up to the range. A query opens the node with the highest sum
of its terms' maxima first and descends until no node's sum reaches the k-th score found; nodes whose sum equals it are opened,
as their documents may tie. Over the ranges it is the same: the ranges with the highest sums are searched first, and the k-th
score found there is the floor below which the roots of all others stay closed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, lower_ascii, pieces, utf8, written
from .terms import ALNUM, Asked, term_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and postings after which a range is full; children of a node.
RANGE_DOCS, RANGE_POSTINGS, FAN = 4096, 1 << 20, 16
#: Items and terms that are searched for in one pass over the documents; more items take more passes.
ITEMS, TERMS = 2048, 1 << 15
#: Ranges that each item searches for its floor.
SEEDS = 2

INDEX = "range bigint, n_docs bigint, n_terms bigint, ids array<bigint>, n array<bigint>, begin array<int>, code array<int>, tf array<int>, terms array<int>, df array<bigint>"


def _ranges(batches, asked: Asked) -> Iterator[pa.RecordBatch]:
    """The index rows of a partition's documents (doc_id, text), in their order."""
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, n, held, code, tf = [], [], [], [], []
    docs = terms = postings = 0

    def row() -> pa.RecordBatch:
        begin = np.zeros(sum(map(len, held)) + 1, np.int32)
        np.cumsum(np.concatenate([np.zeros(0, np.int64), *held]), out=begin[1:])
        codes = np.concatenate([np.zeros(0, np.int32), *code])
        known, df = np.unique(codes, return_counts=True)
        lists = [pa.concat_arrays(ids) if ids else pa.array([], pa.int64()), np.concatenate([np.zeros(0, np.int64), *n]), begin, codes, np.concatenate([np.zeros(0, np.int32), *tf]), known.astype(np.int32), df.astype(np.int64)]
        each = [pa.array([base + made]), pa.array([docs]), pa.array([terms])]
        arrays = [pa.array(x) if isinstance(x, np.ndarray) else x for x in lists]
        return pa.RecordBatch.from_arrays(each + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays], names=[x.split()[0] for x in INDEX.split(", ")])

    for whole in batches:
        for part in pieces((whole.slice(k, RANGE_DOCS // 2) for k in range(0, whole.num_rows, RANGE_DOCS // 2)), "text"):
            raw, at = utf8(part.column(1))
            raw = lower_ascii(raw)
            begin, end, first = term_spans(raw, at, ALNUM)
            size = np.diff(first)
            which, codes = asked.found(raw, begin, end)
            key, times = np.unique((np.searchsorted(first, which, "right") - 1) * len(asked.code) + codes, return_counts=True)
            doc = key // max(len(asked.code), 1)
            own, per = np.unique(doc, return_counts=True)
            if docs and (docs + part.num_rows > RANGE_DOCS or postings + len(key) > RANGE_POSTINGS):
                yield row()
                made += 1
                ids, n, held, code, tf = [], [], [], [], []
                docs = terms = postings = 0
            docs, terms, postings = docs + int((size > 0).sum()), terms + int(size.sum()), postings + len(key)
            ids.append(part.column(0).take(pa.array(own)))
            n.append(size[own])
            held.append(per)
            code.append((key % max(len(asked.code), 1)).astype(np.int32))
            tf.append(times.astype(np.int32))
    if docs:
        yield row()


class Tree:
    """A range of documents with the trees of its terms."""

    def __init__(self, row: dict, weight: np.ndarray, n_docs: int, n_terms: int):
        get = lambda name: np.asarray(row[name].values, np.int64)
        self.ids, self.begin = row["ids"].values, get("begin")
        code, tf = get("code"), get("tf")
        length = 100 - 50 + 50 * get("n") * n_docs // n_terms
        doc = np.repeat(np.arange(len(length)), np.diff(self.begin))
        self.part = weight[code] * (1_000_000_000 * tf // (1000 * tf + 20 * length[doc]))
        self.terms, self.row = np.unique(code, return_inverse=True)
        blocks = -(-len(length) // FAN)
        lowest = np.zeros(len(self.terms) * blocks, np.int64)
        order = np.argsort(self.row, kind="stable")  # documents of a term stay in order
        place = self.row[order] * blocks + doc[order] // FAN
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        lowest[place[starts]] = np.maximum.reduceat(self.part[order], starts)
        self.levels = [lowest.reshape(len(self.terms), blocks)]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            width = -(-low.shape[1] // FAN)
            full = np.zeros((len(low), width * FAN), np.int64)
            full[:, : low.shape[1]] = low
            self.levels.append(full.reshape(len(low), width, FAN).max(axis=2))

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[place] == codes, place, -1)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """The root's maximum for each row, 0 for -1."""
        return np.where(rows >= 0, self.levels[-1][rows, 0], 0)

    def search(self, rows: np.ndarray, k: int, least: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at least `least`: the k best and all that tie with the last. asked: False for each term."""
        asked[rows] = True
        top: list[int] = []
        docs, scores = [], []
        nodes = [(-int(self.levels[-1][rows, 0].sum()), len(self.levels) - 1, 0)]
        while nodes and -nodes[0][0] >= least:
            _, level, node = heapq.heappop(nodes)
            if level:
                low = self.levels[level - 1]
                sums = low[rows, node * FAN : (node + 1) * FAN].sum(axis=0)
                for child in np.flatnonzero(sums >= least).tolist():
                    heapq.heappush(nodes, (-int(sums[child]), level - 1, node * FAN + child))
                continue
            first = self.begin[node * FAN : (node + 1) * FAN + 1]
            span = slice(first[0], first[-1])
            sums = np.add.reduceat(np.where(asked[self.row[span]], self.part[span], 0), first[:-1] - first[0])
            for child in np.flatnonzero(sums >= least).tolist():
                score = int(sums[child])
                docs.append(node * FAN + child)
                scores.append(score)
                heapq.heappush(top, score) if len(top) < k else heapq.heappushpop(top, score)
            if len(top) == k:
                least = max(least, top[0])
        asked[rows] = False
        docs, scores = np.array(docs, np.int64), np.array(scores, np.int64)
        return docs[scores >= least], scores[scores >= least]


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(i)[k] for i, name in enumerate(b.schema.names)}


def _bounds(batches, weight, n_docs, n_terms, codes, starts) -> Iterator[pa.RecordBatch]:
    """(item, range, bound) of the items that have a term in the range."""
    for row in _rows(batches):
        if len(row["code"].values):
            tree = Tree(row, weight, n_docs, n_terms)
            sums = np.add.reduceat(tree.bound(tree.rows_of(codes)), starts)
            item = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(np.full(len(item), row["range"].as_py())), pa.array(sums[item])], names=["item", "range", "bound"])


def _search(batches, weight, n_docs, n_terms, codes, starts, least, k) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score) of at most k documents of a range and item; the items are those in `asked` if there is such a column."""
    ends = np.append(starts[1:], len(codes))
    for row in _rows(batches):
        if not len(row["code"].values):
            continue
        tree = Tree(row, weight, n_docs, n_terms)
        places = tree.rows_of(codes)
        sums = np.add.reduceat(tree.bound(places), starts)
        items = np.asarray(row["asked"].values, np.int64) if "asked" in row else np.arange(len(starts))
        flags = np.zeros(len(tree.terms), bool)
        for item in items[sums[items] >= np.maximum(least[items], 1)].tolist():
            rows = places[starts[item] : ends[item]]
            docs, scores = tree.search(rows[rows >= 0], k, max(int(least[item]), 1), flags)
            ids = tree.ids.take(pa.array(docs)).to_pylist()
            best = sorted(zip((-scores).tolist(), (i is None for i in ids), (i or 0 for i in ids), range(len(ids)), strict=True))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), item, np.int32)), pa.array([ids[x[3]] for x in best], pa.int64()), pa.array([-x[0] for x in best], pa.int64())], names=["item", "doc_id", "score"])


def _blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """The items (id, distinct terms) in blocks, drawn one partition at a time."""
    block, terms = [], 0
    for item, own in items.toLocalIterator():
        if block and (len(block) >= most_items or terms + len(own) > most_terms):
            yield block
            block, terms = [], 0
        block.append((item, own))
        terms += len(own)
    if block:
        yield block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, most_items: int = ITEMS, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties by doc_id, a null doc_id last.

    docs: doc_id, text; items: item_id, text; other columns aren't read, whatever their names. Null and empty texts have no terms:
    such documents are not ranked or counted, such items get no rows, and neither does any item if no document has a term. Rows that
    repeat are documents and items of their own. A text is read whole, however long. Items come in blocks; each is a pass over the documents.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    wanted = items.select("item_id", words.alias("terms")).filter(F.size("terms") > 0)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    results: list[DataFrame] = []
    last = None
    for block in _blocks(wanted, most_items, most_terms):
        if last is not None:  # the block before is not the only one: its rows are kept, and its index goes
            results[-1] = written(results[-1])
            discarded(last)
        terms = sorted({t for _, own in block for t in own})
        code = {t: k for k, t in enumerate(terms)}
        codes = np.array([code[t] for _, own in block for t in own], np.int64)
        starts = np.cumsum([0, *(len(own) for _, own in block)])[:-1]
        last = written(slim.mapInArrow(partial(_ranges, asked=Asked(terms)), INDEX))
        n_docs, n_terms = last.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            break
        weight = np.zeros(len(terms), np.int64)
        held = last.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df"))
        for term, df in held.toLocalIterator():  # of the block's terms at most
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        know = {"weight": weight, "n_docs": n_docs, "n_terms": n_terms, "codes": codes, "starts": starts}
        bounds = last.mapInArrow(partial(_bounds, **know), "item int, range bigint, bound bigint")
        first = Window.partitionBy("item").orderBy(F.desc("bound"), "range")
        seeds = bounds.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= SEEDS).groupBy("range").agg(F.collect_list("item").alias("asked"))
        least = np.zeros(len(block), np.int64)
        shape = "item int, doc_id bigint, score bigint"
        seeded = _ranked(last.join(seeds, "range").mapInArrow(partial(_search, **know, least=least, k=k), shape), k)
        for item, score in seeded.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("item", "least").toLocalIterator():
            least[item] = score  # of the block's items at most
        found = _ranked(last.mapInArrow(partial(_search, **know, least=least, k=k), shape), k)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return items.select("item_id").limit(0).selectExpr("item_id", "0 rank", "cast(0 as bigint) doc_id", "cast(0 as bigint) score")
    whole = results[0]
    for more in results[1:]:
        whole = whole.union(more)
    return whole


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
sizes AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS nt FROM d WHERE len(t) > 0),
tfs AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, sizes GROUP BY term, nd),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark)),
scores AS (SELECT i, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))))::BIGINT AS score
  FROM q JOIN tfs USING (term) JOIN weights USING (term), sizes GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50
"""
