"""Repeats, BPE, near duplicates, classifiers, scoring, HTML and the pipeline against brute force and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, exact, htmltext, induced, langid, neardup, quality, repetition, scoring

from .test_native_ops import DOCS, ODD, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("clash"), "key": F.lit(1), "node": F.lit("x")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Suffix-array repetition.


def repeated(w, k):
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({x for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for x in range(i, i + k)})


def longest(w):
    return max((k for k in range(1, len(w)) if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1), default=0)


def test_repetition_figures():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + rng.choice(["", "\nx y\nx y\n", "\n#*é|"]) for _ in range(300)] + ["", "w " * 500, "a b c d e " * 30]
    x = repetition.measures(pa.array(texts))
    for k, t in enumerate(texts):
        w = words(t)
        lines = [s for s in t.split("\n") if words(s)]
        wanted = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(w, 5), repeated(w, 10), longest(w))
        assert tuple(int(x[n][k]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")) == wanted


def test_quality_rules_of_odd_rows(odd, none):
    rows = repetition.quality_rules(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert repetition.quality_rules(none).count() == 0 and repetition.keep_good(odd).columns == odd.columns


# Induced sorting and removal of repeats.


@pytest.mark.parametrize(("short", "block", "symbols", "memory"), [(4, 7, 4, 100), (4, 1 << 15, 1 << 12, 1 << 28), (1 << 21, 1 << 15, 1 << 12, 1 << 28)])
def test_suffix_order(monkeypatch, short, block, symbols, memory):
    for name, value in (("SHORT", short), ("BLOCK", block), ("SYMBOLS", symbols), ("RANGE", 2 if block == 7 else 64)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(1)
    for k in range(60):
        n, s = int(rng.integers(2, 200)), int(rng.integers(2, 6))
        t = rng.integers(1, s, n)
        t = np.append(np.tile(t[: int(rng.integers(1, 20))], 20)[:n] if k % 3 == 0 else t, 0).astype(np.int32)
        with induced.Room(memory) as room:
            order, shared = (x.tolist() for x in induced.suffix_order(t, s, 1 << 20, room))
        t = t.tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(t[a:], t[b:])) if x != y), min(len(t) - a, len(t) - b))
        assert shared == [0] + [common(a, b) for a, b in zip(order, order[1:])]


def brute_rest(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        out.append((sum(hit), sum(b and not a for a, b in zip([False, *hit], hit)), bytes(b for b, h in zip(t, hit) if not h)))
    return out


def test_removed_repeats(spark, odd, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 9)))
    shared = " ".join(word() for _ in range(120))
    texts = []
    for k in range(120):
        t = " ".join(word() for _ in range(rng.randrange(5, 150)))
        if k % 3 == 0:
            a = rng.randrange(100)
            t += shared[a : a + rng.randrange(350, 600)] + t
        if k % 10 == 0 and texts:
            t = texts[rng.randrange(len(texts))].replace("a", "b", k % 20)
        texts.append(t)
    texts += ["ab" * 700, "x" * 401, "y" * 400, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    found = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in exact.removed_repeats(docs).collect()}
    wanted = brute_rest([t.encode() for t in texts], 400)
    assert found == {k: (n, s, hashlib.sha256(rest).hexdigest()) for k, (n, s, rest) in enumerate(wanted)}
    rest = {r.doc_id: r.text for r in exact.without_repeats(docs).collect()}
    assert rest == {k: r.decode("utf-8", "ignore") for k, (_, _, r) in enumerate(wanted)}
    assert exact.removed_repeats(odd).count() == len(ODD) and exact.removed_repeats(none).count() == 0
    assert exact.without_repeats(odd).columns == odd.columns


@pytest.mark.parametrize("shard", [exact.SHARD_BYTES, 300_000])
def test_shards_of_the_query_are_induced_and_spooled(monkeypatch, spark, sf, shard):
    calls, files = [], []
    induce, path = induced.induce, induced.Room.path
    monkeypatch.setattr(induced, "induce", lambda text, *rest: calls.append(len(text)) or induce(text, *rest))
    monkeypatch.setattr(induced.Room, "path", lambda room: files.append(path(room)) or files[-1])
    text = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text).encode()[:700_000]
    parts = [text[k : k + 900] for k in range(0, len(text) - 900, 450)]
    n = len(parts)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([1] * n), pa.array(range(n)), pa.array([0] * n), pa.array([1] * n), pa.array(parts, pa.binary())], names=["part", "h", "seg", "at", "weight", "bytes"])
    found = {r["seg"]: [(x["a"], x["b"]) for x in r["spans"]] for b in exact._sort_shards([batch], 400, exact.MEMORY, shard) for r in b.to_pylist()}
    # One text, far beyond the memory for tuples: sorted once for the names and once for the suffixes, from disk.
    assert shard // 2 < max(calls) < 1.05 * shard and len(calls) >= 2 and (shard < 900_000 or len(files) > 3)
    count = Counter(p[i : i + 400] for p in parts for i in range(len(p) - 399))
    for k, p in enumerate(parts):
        hit = np.zeros(len(p), bool)
        for i in range(len(p) - 399):
            if count[p[i : i + 400]] > 1:
                hit[i : i + 400] = True
        got = np.zeros(len(p), bool)
        for a, b in found.get(k, []):
            got[a:b] = True
        assert (hit == got).all()


def test_large_groups_of_one_hash_are_split(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    common = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(60)) + common + " ".join(word() for _ in range(60)) for _ in range(80)]
    texts += [t[rng.randrange(100) :][:700] for t in texts[:30]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    wanted = {hashlib.md5(t.encode()).digest(): (sum_, runs) for t, (sum_, runs, _) in zip(texts, brute_rest([t.encode() for t in texts], 400))}
    found = {bytes(r.key): (r.n_removed, r.n_spans) for r in exact.remainders(docs, True, shard_bytes=3000).collect()}
    assert found == wanted and any(n for n, _ in wanted.values())


def test_a_common_passage_is_sorted_once(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    common = " ".join(word() for _ in range(150))[:800]
    texts = [" ".join(word() for _ in range(90)) + common + " ".join(word() for _ in range(90)) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    cut, _, steps = exact.strings_to_sort(exact.distinct_texts(docs), shard_bytes=8000)
    rows = cut.collect()
    held = Counter()
    for r in rows:
        held[r.part] += len(r.bytes)
    assert len({(r.part, bytes(r.bytes)) for r in rows}) == len(rows)
    # Every text has the passage; none of the parts grows with their number.
    assert all(at.count() > 200 for at, _ in steps) and max(r.weight for r in rows) == 200 and max(held.values()) < 8000
    wanted = {hashlib.md5(t.encode()).digest(): (n, runs) for t, (n, runs, _) in zip(texts, brute_rest([t.encode() for t in texts], 400))}
    found = {bytes(r.key): (r.n_removed, r.n_spans) for r in exact.remainders(docs, True, shard_bytes=8000).collect()}
    assert found == wanted and all(n >= 800 for n, _ in wanted.values())


def test_clashing_names_of_the_stages(spark):
    rows = [(1, "a b c d e f g h i j k l", 1, 2, 3, 4, 5), (1, "a b c d e f g h i j k l", 1, 2, 3, 4, 5), (2, "other words of a text that is here alone for now", 9, 8, 7, 6, 5)]
    names = "doc_id bigint, text string, _own int, _KEY int, __node int, _times int, `_rest` int"
    docs = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, exact.without_repeats(docs).collect())) == sorted(rows)
    assert sorted(map(tuple, neardup.one_of_each(docs).collect())) == sorted(set(rows))


# BPE.


def test_bpe_equals_the_library(spark, odd, none, sf):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(bpe.tokenizer_path()), bpe.encoder(bpe.tokenizer_path())
    strange = ["", "  a  b\n\n c", "x  y   　z", "a<|endoftext|>b c", "é à ç  ñ", " lead", "trail ", "don't 's we'll", "日本 語 テスト", "🎉 a 🎉 b", "\x85 \x85 x", "     x", "a \x1c b", "\ta b \r\n c", None, "long " * 5000, "a     b   c"]
    texts = strange + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for _ in range(2):
        ids, first = bpe.encoded(coder, pa.array(texts))
        for k, t in enumerate(texts):
            wanted = library.encode(t or "", add_special_tokens=False).ids
            assert ids[first[k] : first[k + 1]].tolist() == wanted
            assert coder.decode(np.array(wanted, np.int64)).decode() == library.decode(wanted, skip_special_tokens=False)
    assert bpe.digests(odd).count() == len(ODD) and bpe.digests(none).count() == 0
    back = bpe.decode(bpe.encode(odd)).select("doc_id", "text").collect()
    assert sorted(r.text for r in back) == sorted(d[1] or "" for d in ODD)


def test_joins_are_repaired():
    coder = bpe.encoder(bpe.tokenizer_path())
    whole = coder.encode_chunk("hello world again")
    assert coder.repaired([b"hel", b"lo wor", b"ld again"]) == whole and coder.joins(b"hello", b" world") and not coder.joins(b"hel", b"lo")


# Near duplicates.


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(3)
    pairs = []
    for _ in range(80):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 120))]
        b = list(a)
        for _ in range(rng.randrange(30)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30)) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        pairs.append((a, b))
    most = np.array([int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs])
    found = neardup.edit_distances([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs], most.copy())
    assert found.tolist() == [min(distance(a, b), m + 1) for (a, b), m in zip(pairs, most.tolist())]
    shared = neardup.shared_words([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert shared.tolist() == [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]


def test_classes_against_all_pairs(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = texts[i], texts[j]
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) <= most and find(i) != find(j):
                if neardup.edit_distances([np.array([hash(w) & (2**63 - 1) for w in x], np.uint64) for x in (a,)], [np.array([hash(w) & (2**63 - 1) for w in x], np.uint64) for x in (b,)], np.array([most]))[0] <= most:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    wanted = {i: find(i) for i in texts}
    same = sum(found[i] == wanted[i] for i in texts)
    assert all(wanted[c] == wanted[i] for i, c in found.items()) and same >= 0.98 * len(texts)
    kept = neardup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values())) and kept.columns == docs.columns
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.class_id for r in rows if r.doc_id in (1, 8)} == {1}
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.one_of_each(odd).count() == len(ODD) - 2


def test_all_of_a_large_bucket_meet(spark):
    # All shingles that the last two texts share lie in a header that hundreds of texts have.
    head = " ".join(f"h{k}" for k in range(60))
    docs = [(i, head + " " + " ".join(f"d{i}x{k}" for k in range(40))) for i in range(400)]
    docs += [(400 + i, head + " " + " ".join(f"same{k}" if k % 2 else f"e{i}x{k}" for k in range(40))) for i in range(2)]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == {i: min(i, 400) for i in range(402)}


def test_a_rare_element_in_a_large_bucket_is_met(spark):
    # One of 17 four-word runs of the last two texts is whole in both, and a hundred texts end with it.
    docs = [(i, " ".join(f"d{i}x{k}" for k in range(16)) + " so ends this text") for i in range(100)]
    docs += [(100 + i, " ".join(f"e{i}x{k}" if k % 4 == 3 else f"same{k}" for k in range(16)) + " so ends this text") for i in range(2)]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == {i: min(i, 100) for i in range(102)}


def test_near_texts_meet(spark):
    rng, docs, wanted = random.Random(5), [], {}
    cases = [(n, int(0.2 * n)) for n in (6, 7, 9, 12, 16, 19, 20, 24, 50, 100, 300)] * 12
    for k, (n, edits) in enumerate(cases):
        a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        b = list(a)
        for i in [n // 2] if edits == 1 else rng.sample(range(n), edits):
            b[i] = f"v{rng.randrange(10**9)}"
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        wanted |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == wanted


# Classifiers.


def test_language(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in langid.languages(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [rows[i].lang_pred == lang[i] for i in rows if rows[i].held_out]
    assert sum(held) >= 0.97 * len(held)
    assert {r.lang_pred for r in langid.languages(odd).collect() if r.doc_id in (2, 3, 10)} == {"und"}
    assert langid.languages(none).count() == 0


def test_language_sample_counts_copies_once(spark, monkeypatch):
    copies = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text again and again").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(4000, 4040).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda texts: seen.update(texts))
    langid.train(copies.union(others), 30)
    wanted = {r.text for r in copies.union(others).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert len(wanted) > 30 == len(seen["en"]) == len(set(seen["en"])) and set(seen["en"]) <= wanted


def test_kneser_ney_sums_to_one():
    model = langid.Model({"x": ["abca bcab cabc", "aab"], "y": ["zzz yyy zyx"], "z": ["日本語 一二三 語", "ひらがな"]})
    contexts = np.unique(model.grams(model.codes(langid.fold(["abca zyx 日本語q"])[0]), 3))
    for c in contexts:
        grams = (c << np.uint64(langid.BITS)) + np.arange(model.size, dtype=np.uint64)
        for lang in "xyz":
            assert np.exp2(model.log_probability(lang, grams)).sum() == pytest.approx(1, abs=1e-9)


def test_kneser_ney_by_hand():
    """The recursion written out over counts of tuples, for every character of some texts."""
    texts = ["abca bcab cabc", "aab", "bca bca"]
    model = langid.Model({"x": texts})
    letters = sorted(set("".join(texts)) - {" "})
    grams = Counter()
    seen = [0, 0, 0]  # places before the first read as boundaries, as do those before a text
    for t in texts:
        codes = [0] + [letters.index(c) + 1 if c != " " else 0 for c in t]
        for k, c in enumerate(codes):
            seen.append(c)
            if k:
                grams[tuple(seen[-4:])] += 1
    counts = {4: grams}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        if not gram:
            return 1 / (len(letters) + 2)
        own = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        return max(own.get(gram, 0) - 0.75, 0) / total + 0.75 * len(own) / total * p(gram[1:])

    for gram in [*grams, (1, 2, 3, 1), (0, 0, 4, 4), (3, 3, 3, 3)]:
        number = sum(c << (langid.BITS * (3 - k)) for k, c in enumerate(gram))
        assert np.exp2(model.log_probability("x", np.array([number], np.uint64)))[0] == pytest.approx(p(gram), rel=1e-9)


def test_languages_of_many_scripts(spark):
    rows, k = [], 0
    for lang, first, n in (("zh", 0x4E00, 900), ("ko", 0xAC00, 900), ("ru", 0x430, 32), ("en", 97, 26)):
        rng = random.Random(lang)
        for _ in range(40):
            rows.append((k, " ".join("".join(chr(first + int(n * rng.random() ** 2)) for _ in range(rng.randrange(2, 7))) for _ in range(40)), lang))
            k += 1
    found = {r.doc_id: r.lang_pred for r in langid.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found == {i: lang for i, _, lang in rows}


def test_quality(spark, sf, odd, none):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    marked = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect()]
    assert sum(a == b for a, b in marked) >= 0.9 * len(marked)
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.classified(odd, empty).count() == len(ODD) and quality.classified(none, labels).count() == 0


def test_factorisation_identity():
    m = quality.FactorisationMachine(20, 3)
    m.w[:] = np.arange(20)
    ids, x = np.array([3, 5, 9]), np.array([0.5, 2.0, 1.0], np.float32)
    pairs = sum(float(m.v[ids[i]] @ m.v[ids[j]]) * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.raw(ids, x, np.array([0, 3]))[0][0] == pytest.approx(float((m.w[ids] * x).sum()) + pairs, rel=1e-5)


# Scoring.


def test_scores(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = {r.doc_id: [*words(low(r.text)), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = scoring.scores(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r.score) and r.score < 0
    assert scoring.scores(odd).count() == len(ODD) and scoring.scores(none).count() == 0


def test_all_passages_are_trained_on():
    path = bpe.tokenizer_path()
    texts = [" ".join(f"word{i} of{k}" for i in range(k)) for k in (1, 30, 200, 900)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4), pa.array([True, True, False, True]), pa.array(texts)], names=["block", "train", "text"])
    passages = [np.array(x) for b in scoring._passages([batch], path) for x in b.column(0).to_pylist()]
    coder = bpe.encoder(path)
    wanted = np.concatenate([scoring._ids(coder, words(texts[k]))[0] for k in (0, 1, 3)])
    assert np.concatenate(passages).tolist() == wanted.tolist()
    size, k = len(coder.bytes), 1 + scoring.HEADS + scoring.INNER
    initial = np.array([x[:1] == b" " for x in coder.bytes])
    m = scoring.Scorer(np.ones((size, scoring.SIDES)), initial, scoring._classes(np.ones((size, scoring.SIDES)), initial), np.ones((k, size)), np.ones(k), 3)
    assert m.steps(passages, 0)[1] == m.steps(passages[:3], 0)[1] + m.steps(passages[3:], 0)[1] == sum(len(p) - 1 for p in passages)


def test_scorer_gradients_and_sums():
    rng = np.random.default_rng(0)
    size = 50
    initial = np.arange(size) % 2 == 0
    sides = rng.integers(0, 9, (size, scoring.SIDES)).astype(float)
    classes = scoring._classes(sides, initial)
    k = 1 + scoring.HEADS + scoring.INNER
    m = scoring.Scorer(sides, initial, classes, rng.integers(0, 5, (k, size)) * (~initial).astype(float), np.append(0, rng.integers(1, 9, k - 1)).astype(float), 10)
    w = {n: x + rng.normal(0, 0.2, x.shape) for n, x in m.weights.items()}
    ids = rng.integers(0, size, 40)
    g, _ = m.gradients(w, ids[:-1], ids[1:], np.array([39]), np.ones(39, bool))
    for n in w:
        at = (int(m.row[ids[3]]), 1) if n == "embed" else tuple(0 for _ in w[n].shape)
        up, down = ({q: x.copy() for q, x in w.items()} for _ in range(2))
        up[n][at] += 1e-4
        down[n][at] -= 1e-4
        slope = (m.gradients(up, ids[:-1], ids[1:], np.array([39]), np.ones(39, bool))[1] - m.gradients(down, ids[:-1], ids[1:], np.array([39]), np.ones(39, bool))[1]) / 2e-4 / 39
        assert g[n][at] == pytest.approx(slope, rel=1e-3, abs=1e-7)
    m.weights = {n: x.astype(np.float32) for n, x in w.items()}
    total = sum(math.exp(m.log_probabilities(np.append(m.end, ids[:20]), np.append(ids[:20], t), np.array([21]))[-1]) for t in range(size + 1))
    assert total == pytest.approx(1, abs=1e-3)
    # Words of two, one and three ids, then the end: each by its ids and its stop, mixed with its share.
    stream = np.array([2, 1, 4, 6, 3, 5])
    before, after = np.append(m.end, stream), np.append(stream, m.end)
    p, stop = m.logs(before, after, np.array([7]))
    for t in range(7):
        seen = np.array([m.log_probabilities(before[: t + 1], np.append(after[:t], x), np.array([t + 1]))[-1] for x in [*np.flatnonzero(initial), m.end]])
        assert math.exp(stop[t]) == pytest.approx(np.exp(seen).sum(), abs=1e-3)
    shares = [0.2, 0.0, 0.05, 0.1]
    spelled = [p[0] + p[1] - stop[0] + stop[2], p[2] - stop[2] + stop[3], p[3] + p[4] + p[5] - stop[3] + stop[6], p[6] - stop[6]]
    wanted = [math.log((1 - scoring.MIX) * math.exp(x) + scoring.MIX * y) for x, y in zip(spelled, shares)]
    assert m.word_logs(before, after, np.array([7]), np.array([0, 2, 3, 6]), np.array([3]), np.array(shares)) == pytest.approx(wanted, abs=1e-4)


# HTML.


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a  b<p>c<br>d", "a b\n\nc\nd"), ("<ul><li>one<li>two<ol start=3><li>x</ol></ul>", "- one\n- two\n  3. x"), ("<table><tr><th>Name<th>N<tr><td>alpha<td>10</table>z", "Name   N\nalpha  10\n\nz"),
        ("<div hidden>n</div><b style='display: NONE'>n</b>x<script>a</script><!-- c -->", "x"), ("<pre>a\n  b</pre>", "a\n  b"), ("<head><title>t</title></head>b &amp; c", "b & c"), (None, ""), ("", ""), ("a<b>c", "ac"), ("1 < 2 <", "1 < 2 <"),
        ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e</table>", "A  b  c\n   d  e"), ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
        ("<style>.no, p#x {display:none} i{visibility:hidden}</style><p class='y no'>a<p id=x>b<p>c<i>d</i>e", "ce"), ("<div>" * 160 + "<div hidden>secret</div>x", "x"),
        ("<div>" * 10000 + "<i hidden>no</i>deep", "deep"), ("<a href=\"x>y\">t</a> <b 'c", "t <b 'c"), ("<div>" * 3000 + "deep", "deep"), ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"),
    ],
)
def test_render(page, text):
    assert htmltext.render(page) == text


@pytest.mark.parametrize("page", ["<a " * 400_000, "<a \"x\" " * 200_000 + "'", "<a '" * 300_000, "<p><table>" + "<span>" * 60_000 + "</p><div></div>" * 60_000, "<!" * 500_000, "<table><tr>" + "<td>x" * 20_000, "<li>" * 100_000 + "</ul>" * 100_000])
def test_hostile_pages_take_seconds(page):
    import time

    began = time.perf_counter()
    htmltext.render(page)
    assert time.perf_counter() - began < 20


def test_all_visible_words_stay(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<(script|style)[^>]*>.*?</\1>", "", r.html)
        plain = html.unescape(re.sub(r"<[^>]*>", " ", body))
        assert re.findall(r"\w+", htmltext.render(r.html)) == re.findall(r"\w+", plain) or "<li" in r.html
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string, text string")).count() == 0


# The pipeline.


def test_pipeline(spark, sf, odd, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = stage(spark, spark.read.parquet(str(tmp_path / str(k))), sf)
        assert docs.columns == (columns if k + 1 < len(P.STAGES) else [*columns, "token_ids"])
    assert docs.count() > 0
    coder = bpe.encoder(bpe.tokenizer_path())
    for r in docs.limit(20).collect():
        assert coder.decode(np.array(r.token_ids, np.int64)).decode() == r.text
    left = odd
    for _, stage in P.STAGES:
        left = stage(spark, left, sf)
    assert left.count() >= 0


def test_rest_pairs_by_runs(spark):
    """Texts of the same words in other order, in one small bucket, are no pairs; near ones are, and so they are by finer counts."""
    draw, texts = random.Random(5), []
    for n in (3, 30, 256, 257, 520, 700, 5900):
        base = [f"w{draw.randrange(400)}" for _ in range(n)]
        near = [f"x{draw.randrange(99)}" if draw.random() < 0.1 else w for w in base]
        texts += [" ".join(x) for x in (base, near, base[: max(1, int(n * 0.85))], draw.sample(base, n))]
    named = pa.RecordBatch.from_arrays([pa.array([b"%02d" % k for k in range(len(texts))]), pa.array(texts)], names=["node", "text"])
    sketched = pa.Table.from_batches(neardup._sketch([named], 5, 24, 2, 32)).to_pylist()
    members = spark.createDataFrame([(7, r["node"], r["n_words"], True, len(texts)) for r in sketched], "key bigint, node binary, n_words int, single boolean, n bigint")
    bags = spark.createDataFrame([(r["node"], r["n_words"], r["bag"]) for r in sketched], "node binary, n_words int, bag binary")
    found = {(int(r.a), int(r.b)) for r in neardup.rest_pairs(members, spark.createDataFrame([], "node binary, root binary"), bags, 0.8)[0].collect()}
    every = list(itertools.combinations(range(len(texts)), 2))
    left, right = (pa.array([texts[p[k]] for p in every]) for k in (0, 1))
    ids = [pa.array([b"%02d" % p[k] for p in every]) for k in (0, 1)]
    want = {(int(r["a"]), int(r["b"])) for b in neardup._verify([pa.RecordBatch.from_arrays([*ids, left, right], names=["a", "b", "a_text", "b_text"])], 0.8) for r in b.to_pylist()}
    assert want and want <= found
    assert not any((k, k + 3) in found for k in (4, 8, 12))
    fine = {r["node"]: r["fine"] for b in neardup._run_counts([named]) for r in b.to_pylist()}
    words, counts = ([pa.array([of[b"%02d" % p[k]] for p in every]) for k in (0, 1)] for of in ({r["node"]: r["n_words"] for r in sketched}, fine))
    rows = pa.RecordBatch.from_arrays([*ids, *words, *counts], names=["a", "b", "a_words", "b_words", "a_fine", "b_fine"])
    finer = {(int(r["a"]), int(r["b"])) for b in neardup._near_by_runs([rows], 0.8) for r in b.to_pylist()}
    assert want <= finer and not any((k, k + 3) in finer for k in range(4, len(texts), 4))
