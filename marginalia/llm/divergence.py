"""Source divergence audit: which terms of a source stand out from its language, and how far sources are apart.

Terms are counted once over all texts. The terms of a (lang, source) group with one count have one probability p there, so they
make a bucket; the least and the most probability that any of them has in the language bound the bucket's values from above.
The 200 best terms of a group are found best first: buckets are opened in the order of their bounds, some more in each round,
until no closed one's bound reaches the 200th value. Pairs of sources come from postings: what a term gives that one of two
sources lacks depends on its bucket only, so whole buckets are taken times their size, and terms that both have correct that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, lower_ascii, mixed, pieces, span_hashes, utf8, written
from .terms import LETTERS, strings, term_spans

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term at least; the scale of probabilities; terms returned of a group.
FEWEST, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text that are counted together; sources in one deal of a join; deals of one bucket's terms.
SLICE, DEAL, SALT = 8 << 20, 64, 16
#: Bytes of a slice that are hashed together.
HASHED = 1 << 20
#: Terms that the first round opens for each group, in TOP, and by how much a round opens more than the one before.
FIRST, MORE = 1, 8


def term_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As `span_hashes`, for spans in order that don't overlap: work arrays, of 40 bytes a byte, hold one stretch of the text at a time."""
    out = np.empty(len(begin), np.uint64)
    cuts = np.searchsorted(begin, np.arange(0, len(raw) + HASHED, HASHED))
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i < j:
            out[i:j] = span_hashes(raw[begin[i] : end[j - 1]], begin[i:j] - begin[i], end[i:j] - begin[i])
    return out


def _counts(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of slices of the rows (lang, source, text)."""
    for part in pieces(batches, "text", SLICE):
        raw, at = utf8(part.column(2))
        raw = lower_ascii(raw)
        begin, end, first = term_spans(raw, at, LETTERS)
        if not len(begin):
            continue
        lang, source = (pc.dictionary_encode(part.column(k)) for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        doc = np.repeat(np.arange(part.num_rows), np.diff(first))
        key = mixed(term_hashes(raw, begin, end) + mixed(group.astype(np.uint64) + np.uint64(1))[doc])
        order = np.argsort(key, kind="stable")  # documents of a term stay in order
        key, doc = key[order], doc[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(fresh)
        fresh[1:] |= doc[1:] != doc[:-1]
        own = order[starts]
        g = group[doc[starts]]
        arrays = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), strings(raw, begin[own], end[own]), pa.array(np.diff(np.append(starts, len(key)))), pa.array(np.add.reduceat(fresh.astype(np.int64), starts))]
        for k in range(0, len(starts), 1 << 16):
            yield pa.RecordBatch.from_arrays([x.slice(k, 1 << 16) for x in arrays], names=["lang", "source", "term", "count", "docs"])


def floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total): decimals, as the product leaves 64 bits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (floor_div(product, total.cast("decimal(20,0)")) + 1).cast("bigint")


def gap(p: Column, q: Column) -> Column:
    return floor_div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): null texts, languages and sources are ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counts, "lang string, source string, term string, count bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(lang, source, term, count, lang_count, head): kept terms, in buckets by term; `head` marks one row of each term of a language."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).repartition(parts, "term")
    kept = counted.withColumns({"_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term), "head": F.row_number().over(term.orderBy("source")) == 1})
    return written(kept.filter(F.col("_docs") >= fewest).select("lang", "source", "term", "count", "lang_count", "head"), "term", parts, dealt=True)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each occurring group: lang, source, total (N + V of the group), lang_total, n_terms (of the language), own_terms, p0 (of an absent term)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("own_terms"), F.sum(F.when(F.col("head"), F.col("lang_count"))).alias("part"), F.count_if("head").alias("heads"))
    langs = sizes.groupBy("lang").agg(F.sum("part").alias("lang_n"), F.sum("heads").alias("n_terms"))
    every = docs.select(text("lang"), text("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    both = every.join(sizes.select("lang", "source", "n", "own_terms"), ["lang", "source"], "left").join(langs, "lang", "left")
    total = F.nullif(zero("n") + zero("n_terms"), F.lit(0))
    return both.select("lang", "source", total.alias("total"), (zero("lang_n") + zero("n_terms")).alias("lang_total"), zero("n_terms").alias("n_terms"), zero("own_terms").alias("own_terms"), share(F.lit(0), total).alias("p0"))


def count_buckets(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, count, n, p, p0, bound): `bound` is the most that a term of the bucket can score, null if none is above its language."""
    buckets = kept.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n"), F.min("lang_count").alias("low")).join(groups, ["lang", "source"])
    p, q = share(F.col("count"), F.col("total")), share(F.col("low"), F.col("lang_total"))
    return buckets.withColumns({"p": p, "q": q}).select("lang", "source", "count", "n", "p", "p0", "lang_total", F.when(F.col("p") > F.col("q"), gap(F.col("p"), F.col("q"))).alias("bound"))


def standing_out(kept: DataFrame, buckets: DataFrame, top: int = TOP, first: int = FIRST, more: int = MORE) -> DataFrame:
    """(lang, source, item, value, rank): each group's `top` terms whose share is above that in their language, best first over the buckets."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "count")
    ahead = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ready = written(buckets.filter("bound is not null").withColumn("ahead", ahead))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)))
    budget, best, closed = first * top, None, ready
    while True:
        opened = closed.filter(F.col("ahead") < budget).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        q = share(F.col("lang_count"), F.col("lang_total"))
        seen = salted.join(opened, ["lang", "source", "count", "salt"]).withColumn("q", q).filter(F.col("p") > F.col("q"))
        seen = seen.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        if best is not None:
            seen = seen.unionByName(best.drop("rank"))
        before, best = best, written(seen.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top))
        kth = best.filter(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        # What is closed and may still reach the last value: a group of fewer terms has no last value yet.
        rest = ready.filter(F.col("ahead") >= budget).join(kth, ["lang", "source"], "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        if before is not None:
            discarded(before)
        if rest.isEmpty():
            discarded(ready)
            return best
        closed, budget = rest, budget * more


def pair_values(kept: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language, both ways, the values of all kept terms summed."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    deals = max(1, -(-most // DEAL))
    # Sources are dealt out: what meets them comes once for each deal, so that no task has a whole language's pairs.
    deal, turns = F.pmod(F.xxhash64("source"), F.lit(deals)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))).alias("deal")
    other = groups.select("lang", F.col("source").alias("item"), F.col("own_terms").alias("item_terms"), F.col("p0").alias("q0"), deal.alias("deal"))
    c = F.col
    met = groups.select("*", turns).join(other, ["lang", "deal"]).filter("source <> item")
    absent = F.when(c("n_terms") > 0, (c("n_terms") - c("own_terms") - c("item_terms")) * gap(c("p0"), c("q0"))).otherwise(0)
    parts = met.select("lang", "source", "item", absent.cast("bigint").alias("value"))

    single = buckets.select("lang", "source", "n", "p", turns).join(other, ["lang", "deal"]).filter("source <> item")
    both_ways = F.explode(F.array(F.struct(c("source"), c("item"), (c("n") * gap(c("p"), c("q0"))).alias("value")), F.struct(c("item").alias("source"), c("source").alias("item"), (c("n") * gap(c("q0"), c("p"))).alias("value"))))
    parts = parts.union(single.select("lang", both_ways.alias("x")).select("lang", "x.source", "x.item", "x.value"))

    known = kept.join(groups.select("lang", "source", "total", "p0"), ["lang", "source"]).select("lang", "term", "source", share(c("count"), c("total")).alias("p"), "p0")
    left, right = known.select("*", turns), known.select("lang", "term", c("source").alias("item"), c("p").alias("q"), c("p0").alias("q0"), deal.alias("deal"))
    shared = left.join(right, ["lang", "term", "deal"]).filter("source < item")
    change = lambda p, p0, q, q0: F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0))
    shared = shared.groupBy("lang", "source", "item").agg(change(c("p"), c("p0"), c("q"), c("q0")).alias("there"), change(c("q"), c("q0"), c("p"), c("p0")).alias("back"))
    both_ways = F.explode(F.array(F.struct("source", "item", c("there").alias("value")), F.struct(c("item").alias("source"), c("source").alias("item"), c("back").alias("value"))))
    parts = parts.union(shared.select("lang", both_ways.alias("x")).select("lang", "x.source", "x.item", "x.value"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, fewest: int = FEWEST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source of a group's language, `term` rows for the group's
    `top` terms that stand out most; both from 1 by value, ties by item in UTF-8 order.

    A null text, lang or source is ''. A group without kept terms has pairs and no term rows; a language without kept terms has
    pairs of value 0; a language with one source has no pairs. Rows that repeat are documents of their own. Texts are read whole,
    however long. An empty table gives no rows. Columns other than lang, source and text aren't read, whatever their names.
    Terms of one slice (8 MB of text) are told apart by 64-bit hashes, those of different slices by their text.
    """
    kept = postings(docs, fewest)
    groups = written(group_sizes(docs, kept))
    buckets = written(count_buckets(kept, groups))
    terms = standing_out(kept, buckets, top)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups, buckets).withColumn("rank", F.row_number().over(ranks))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")
    return shape(pairs, "pair").union(shape(terms, "term"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS lang_c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {FEWEST}),
langs AS (SELECT lang, sum(lang_c)::BIGINT AS n, count(*)::BIGINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c)::BIGINT AS n FROM own GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + ({SCALE}::BIGINT * (coalesce(c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + ({SCALE}::BIGINT * (k.lang_c + 1)) // (l.n + l.v) AS ql
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own USING (lang, source, term) LEFT JOIN sizes s USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - ql) * (p - ql)) // ql FROM p WHERE c > 0 AND p > ql)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= {TOP}
"""
