"""Fingerprints and mixing: brute force and invariants, and odd tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import fingerprints, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "a b c d e f g", "en", "s1", 13), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "null id here", "en", "s2", 12), (5, "é" * 9, "fr", "s2", 9),
    (5, "same id other text", "fr", "s2", 18), (7, "word " * 3000, "en", "s1", 15000), (8, "a b c d e f g", "en", "s1", 13), (8, "a b c d e f g", "en", "s1", 13), (10, " \t\n ", "de", "s1", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("clash"), "key": F.lit(1), "node": F.lit("x")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_fingerprints(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    wanted = []
    for k, d in enumerate(order):
        own, following = d[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + following[:q]
        wanted.append((d[0], len(own), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted(wanted, key=key)


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd).collect()
    check_fingerprints(rows, ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 8)}) == 1
    assert fingerprints.fingerprints(none).count() == 0


def test_next_over_many_buckets(spark):
    docs = [(k * k * 7, f"text {k} " * (k % 5 + 1), "en", "s", 1) for k in range(700)]
    check_fingerprints(fingerprints.fingerprints(spark.createDataFrame(docs, DOCS)).collect(), docs)


def test_buckets_of_uneven_ids(spark):
    ids = [*range(2000), 9 * 10**18, -(9 * 10**18), *range(10**12, 10**12 + 500)]
    docs = [(k, f"text {k}", "en", "s", 1) for k in ids]
    df = spark.createDataFrame(docs, DOCS)
    sizes = [r["count"] for r in fingerprints.dealt(df, bucket=16, root=8).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 120 and sum(sizes) == len(ids)
    check_fingerprints(fingerprints.fingerprints(df).collect(), docs)


def test_fingerprints_against_sql(spark, sf):
    import duckdb

    rows = fingerprints.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = list(rows.columns)
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({fingerprints.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, rows[names].itertuples(index=False))) == sorted(wanted)


def test_likeness_estimates_jaccard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = fingerprints.fingerprints(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}
    off = []
    for r in rows:
        own = texts[r.doc_id]
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        q = len(own) // 4
        a, b = shingles(own), shingles(own[: len(own) - q] + after[:q])
        if len(a) > 100:
            off.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert sum(off) / len(off) < 0.06
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_texts_are_compared_whole(spark):
    docs = [(k, " ".join(f"w{(k // 2) * 7 + i}" for i in range(3 + k % 9)), "en", "s", 1) for k in range(120)]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, DOCS)).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}
    for k, text, *_ in docs:
        after = docs[(k + 1) % len(docs)][1]
        q = len(text) // 4
        own, edited, following = shingles(text), shingles(text[: len(text) - q] + after[:q]), shingles(after)
        assert rows[k].near_edited == pytest.approx(len(own & edited) / len(own | edited))
        assert rows[k].near_next == pytest.approx(len(own & following) / len(own | following))
        assert rows[k].contained_in_edited == pytest.approx(len(own & edited) / len(own))


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing again and again."""
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / weight
            return targets
        for i in over:
            targets[i] = most * sizes[i]
        open_ -= over
    return targets


@pytest.mark.parametrize("sizes", [[100, 10, 50], [1, 1000, 3, 900, 0, 7], [5], [0, 0], [10, 10, 10, 10]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, size bigint")
    found = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
    assert found == pytest.approx(level(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))]))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed_sources(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    sizes = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r.taken
    for own, taken, target, source_size in by.values():
        assert own == source_size and abs(taken - target) <= 0.03 * target + 2 * mixing.BLOCK
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed_sources(docs.repartition(5)).collect()))


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mixed_sources(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixed_sources(none).count() == 0
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)


def test_mixed_documents_keep_the_targets_of_long_texts(spark):
    docs = spark.range(1200).select("id", F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 < 4, "b").otherwise("c").alias("source")).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i))).alias("text"), "source")
    targets = {r.source: r.target for r in mixing.mixed_sources(docs).select("source", "target").distinct().collect()}
    found = {r.source: 1000 * r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert {s: found.get(s, 0) for s in targets} == pytest.approx(targets, rel=0.05)
    most = mixing.mixed_documents(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2


@pytest.mark.parametrize("rows", [[(1, "a b c", "s")], [(1, "a b c " * 400, "s"), (2, "d e f " * 300, "s")], [(1, "a " * 90, None)], [(1, None, "s"), (2, "", "t")]])
def test_mix_of_one_source(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in mixing.mixed_sources(docs).collect()}
    for i, text, _ in rows:
        r = found[i]
        assert r["size"] == len(words(text)) and r.target == 1.5 * r.source_size and r.taken <= 2 * r["size"]
    assert abs(sum(r.taken for r in found.values()) - 1.5 * sum(r["size"] for r in found.values())) <= mixing.BLOCK
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_takes_as_the_blocks_that_it_draws(spark):
    """The whole draw by hand: documents in the order of their hashes, blocks of words, slots of shards, permuted passes."""
    docs = spark.createDataFrame([(k, "w " * (5 + 37 * k % 300), "abc"[k % 3]) for k in range(90)], "doc_id bigint, text string, source string")
    rows = mixing.mixed_sources(docs, shard=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    slots = 0
    for own in by.values():
        taken, size = sum(r.taken for r in own), own[0].source_size
        blocks = -(-size // mixing.BLOCK)
        # All blocks of a pass are taken once, so the words per block differ by one pass at most.
        assert size * (taken // size) <= taken <= min(2 * size, size * (taken // size + 1))
        slots += taken / mixing.BLOCK
        assert blocks > 0
    assert abs(slots - sum(x[0].target for x in by.values()) / mixing.BLOCK) <= 4
