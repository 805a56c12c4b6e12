"""Ranked search, source divergence and the n-gram join: brute force, SQL and odd tables."""

import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import divergence, ngramjoin, queries, ranked

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "a b c d e f g", "en", "s1", 13), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "null id here a b", "en", "s2", 12), (5, "é" * 9, "fr", "s2", 9),
    (5, "same id other text", "fr", "s2", 18), (7, "Word two " * 3000, "en", "s1", 15000), (8, "a b c d e f g", "en", "s1", 13), (8, "a b c d e f g", "en", "s1", 13), (10, " \t\n ", "de", "s1", 4),
    (11, "A-b C\nd É2 2x", None, "s2", 4), (12, "É2 2x é two TWO", "", None, 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("clash"), "term": F.lit(1), "node": F.lit("x"), "range": F.lit("y"), "a.b": F.lit(2)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_sql(spark, sf, db, name):
    found, wanted = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    rows = lambda f: sorted((tuple(r) for r in f[columns].values.tolist()), key=str)
    assert columns == sorted(wanted.columns) and rows(found) == rows(wanted)


def best(docs, items, k):
    """Rows of each item by the formula, over all documents."""
    terms = [(d[0], Counter(re.findall(ranked.TERM, lowered(d[1])))) for d in docs]
    held = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(re.findall(ranked.TERM, lowered(text))) if t in c)
            if score:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_ranked_search_is_its_sql(spark, sf, db):
    check_sql(spark, sf, db, "op13_ranked_search")


@pytest.mark.parametrize("k, most_items, most_terms, fan", [(50, 100, 1000, 16), (2, 2, 5, 2), (1, 1, 1, 3)])
def test_ranked_search_of_odd_rows(spark, odd, monkeypatch, k, most_items, most_terms, fan):
    """Few documents in a node and few items in a block, so that trees have levels and blocks follow each other."""
    monkeypatch.setattr(ranked, "FAN", fan)
    items = [(1, "a B two"), (2, None), (3, ""), (4, "é É2 2x"), (5, "unheard"), (None, "word here"), (1, "a B two"), (6, "g " * 2000), (7, "two word a")]
    found = ranked.search(odd, spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("clash")), k, most_items, most_terms)
    assert sorted((tuple(r) for r in found.collect()), key=str) == best(ODD, items, k)


def test_ranked_search_without_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(odd.filter("doc_id in (2, 3, 10)"), items).count() == 0
    assert ranked.search(odd, items.limit(0)).count() == 0


def test_tree_opens_ties_and_closes_the_rest():
    """Of 4096 documents only the blocks with a chance are opened; equal scores all come."""
    import numpy as np
    import pyarrow as pa

    n = 4096
    tf = np.where(np.arange(n) % 512 == 7, 9, 1)
    row = {"ids": pa.scalar(list(range(n))), "n": pa.scalar([10] * n), "begin": pa.scalar(list(range(n + 1))), "code": pa.scalar([0] * n), "tf": pa.scalar(tf.tolist())}
    tree = ranked.Tree(row, np.array([500]), n, 10 * n)
    assert [x.shape[1] for x in tree.levels] == [256, 16, 1]
    docs, scores = tree.search(np.array([0]), 3, 1, np.zeros(1, bool))
    assert sorted(docs.tolist()) == list(range(7, n, 512)) and len(set(scores.tolist())) == 1


def audited(docs, fewest, top):
    """Rows by the formulas, over every term of every group."""
    held = [(d[2] or "", d[3] or "", Counter(re.findall(divergence.TERM, lowered(d[1])))) for d in docs]
    out = []
    for lang in {d[0] for d in held}:
        own = [(s, c) for g, s, c in held if g == lang]
        kept = {t for t, n in Counter(t for _, c in own for t in c).items() if n >= fewest}
        sources = sorted({s for s, _ in own})
        count = {s: Counter() for s in [*sources, None]}
        for s, c in own:
            for t in kept & set(c):
                count[s][t] += c[t]
                count[None][t] += c[t]
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", x[2], -x[0], r + 1) for r, x in enumerate(sorted(pairs))] + [(lang, s, "term", x[2], -x[0], r + 1) for r, x in enumerate(sorted(terms)[:top])]
    return sorted(out)


def test_divergence_counts_a_slice_in_little_memory():
    rng = random.Random(3)
    text = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(2000)) for _ in range(20)] * 45
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(text)), pa.array(["s"] * len(text)), pa.array(text)], names=["lang", "source", "text"])
    assert sum(map(len, text)) > 7 << 20
    tracemalloc.start()
    found = Counter()
    for part in divergence._counts([batch]):
        for row in part.to_pylist():
            found[row["term"]] += row["count"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == Counter(w for t in text for w in t.split())
    assert peak < 200 << 20


def test_divergence_is_its_sql(spark, sf, db):
    check_sql(spark, sf, db, "op11_source_divergence")


@pytest.mark.parametrize("fewest, top", [(3, 200), (1, 200), (1, 2), (2, 1)])
def test_divergence_of_odd_rows(spark, odd, monkeypatch, fewest, top):
    """With sources dealt one by one, and buckets opened a few at a time."""
    monkeypatch.setattr(divergence, "DEAL", 2)
    monkeypatch.setattr(divergence, "MORE", 2)
    extra = [(100 + k, f"a b{k % 4} é{k % 3} c{k % 7} " * (k % 5), "en", f"s{k % 6}", 1) for k in range(60)]
    docs = odd.unionByName(spark.createDataFrame(extra, DOCS), allowMissingColumns=True)
    found = divergence.audit(docs, fewest, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == audited(ODD + extra, fewest, top)


def test_divergence_without_rows_or_terms(spark, odd, none):
    assert divergence.audit(none).count() == 0
    few = odd.filter("doc_id in (1, 3, 2) or doc_id is null")
    assert sorted(tuple(r)[:5] for r in divergence.audit(few).collect()) == [("en", "s1", "pair", "s2", 0), ("en", "s2", "pair", "s1", 0)]


def test_probabilities_beyond_64_bits(spark):
    """Counts of a petabyte: the product with the scale needs more than 64 bits."""
    n = 3 * 10**12
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(7 * 10**12 + 1)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (7 * 10**12 + 1)


def grouped(docs, percent=90):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(d[1]))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            least[find(k)] = min(d[0], least.get(find(k), d[0]))
    return sorted(((d[0], len(sets[k]), least.get(find(k))) for k, d in enumerate(docs)), key=str)


def test_ngram_join_is_its_sql(spark, sf, db):
    check_sql(spark, sf, db, "op12_ngram_join")


def test_ngram_join_of_odd_rows(spark, odd, none):
    assert sorted((tuple(r) for r in ngramjoin.joined(odd).collect()), key=str) == grouped(ODD)
    assert ngramjoin.joined(none).count() == 0
    assert [tuple(r) for r in ngramjoin.joined(odd.filter("doc_id = 10")).collect()] == [(10, 0, 10)]


@pytest.mark.parametrize("deal, most, cost, turns", [(256, 8, 50, 2), (3, 1, 50, 1), (5, 4, 1000, 2)])
def test_ngram_join_of_near_copies(spark, monkeypatch, deal, most, cost, turns):
    """Groups of near copies on both sides of the limit, with a passage that many share and chains of links."""
    import random

    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    docs = []
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 130]))
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                base = own  # the next ones are copies of this one
            text = " ".join(own)
            docs.append((len(docs) * 3 % 101, f"{passage} {text}" if group % 3 == 0 else text.upper() if rng.random() < 0.3 else text, "en", "s", 1))
    monkeypatch.setattr(ngramjoin, "DEAL", deal)
    monkeypatch.setattr(ngramjoin, "PAIRS", deal)
    found = ngramjoin.joined(spark.createDataFrame(docs, DOCS), most=most, cost=cost, turns=turns)
    assert sorted((tuple(r) for r in found.collect()), key=str) == grouped(docs)


def test_prefixes_ask_for_more_where_many_meet():
    """A shingle set in many texts takes a longer prefix with more matches; one with enough shingles of its own meets nobody."""
    import numpy as np

    n = 100
    row, value = np.repeat([0, 1], n), np.tile(np.arange(n, dtype=np.uint64), 2)
    df = np.concatenate([np.full(n, 1000), np.where(np.arange(n) < 30, 1, 1000)])
    sizes, need, held, _, _ = ngramjoin.prefixes(row, value, df, 2, 90, 8, 50)
    assert sizes.tolist() == [100, 100] and need[0] > 1 and need[1] == 1
    assert (held == 0).sum() == 10 + need[0] and (held == 1).sum() == 0


def test_a_text_of_some_megabytes(spark):
    """Longer than a slice: read whole by all three."""
    long = "start " + "middle of a long text " * 400_000 + "last zyx"
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " ", "en", "b", 1), (3, "zyx", "en", "b", 1)], DOCS)
    assert sorted(tuple(r) for r in ngramjoin.joined(docs).collect()) == [(1, 8, 1), (2, 8, 1), (3, 1, 3)]
    items = spark.createDataFrame([(1, "zyx")], "item_id bigint, text string")
    assert [r.doc_id for r in ranked.search(docs, items).orderBy("rank").collect()] == [3, 1, 2]
    assert {r.item for r in divergence.audit(docs, 2).filter("part = 'term'").collect()} <= set(long.split())
