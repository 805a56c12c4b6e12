"""Batches of files: plans, moves, failures, and the same store after a batch that was killed between any two steps."""

import pytest
from pyspark.sql import functions as F

from marginalia.sources.batch import ChunkStore

SCHEMA = "collection string, pdf_filename string, chunk_id string, content string"
FILES = "collection string, pdf_filename string, path string"


def on_disk(spark, *paths):
    return spark.createDataFrame([(p.split("/")[1], p.split("/")[-1], p) for p in paths], FILES)


def chunker(version, broken=()):
    """Two chunks and a blank one for each file; those of `broken` fail."""
    def process(files):
        bad = F.col("pdf_filename").isin(*broken) if broken else F.lit(False)
        each = files.select("collection", "pdf_filename", F.explode(F.array(*map(F.lit, "xyz"))).alias("k"), bad.alias("bad"))
        content = F.when(F.col("k") == "z", " ").otherwise(F.concat(F.lit(version), "k"))
        return each.select("collection", "pdf_filename", F.concat("pdf_filename", "k").alias("chunk_id"), content.alias("content"), F.when(F.col("bad"), "unreadable").alias("error"), F.lit(1).alias("extra"))

    return process


def stored(store):
    return sorted((r.collection, r.pdf_filename, r.chunk_id, r.content) for r in store.chunks().collect())


def counts(store):
    return [tuple(r[c] for c in ("found", "processed", "moved", "skipped", "failed", "removed")) for r in store.summaries().orderBy("gen").collect()]


def test_batches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), SCHEMA)
    assert stored(store) == [] and store.last() == 0
    store.run(on_disk(spark, "p/a/1", "p/a/2", "p/b/3", "p/b/1"), chunker("v1", ["2"]))
    assert counts(store)[-1] == (4, 3, 0, 0, 1, 0)
    assert {r[:2] for r in stored(store)} == {("a", "1"), ("b", "3"), ("b", "1")} and all(r[3] != " " for r in stored(store)) and len(stored(store)) == 6
    # 3 moves to c, b/1 is gone while a/1 stays, 2 is tried again, 4 is there twice.
    store.run(on_disk(spark, "p/a/1", "p/a/2", "p/c/3", "p/a/4", "p/a/sub/4"), chunker("v2"))
    assert counts(store)[-1] == (5, 3, 1, 2, 0, 2)
    assert {(r[0], r[1], r[3][:2]) for r in stored(store)} == {("a", "1", "v1"), ("a", "2", "v2"), ("c", "3", "v2"), ("a", "4", "v2")}
    reasons = {(r.collection, r.pdf_filename, r.status, r.reason) for r in store.table("outcomes").filter("gen = 2").collect()}
    assert {("b", "3", "removed", "moved"), ("b", "1", "removed", "orphan"), ("a", "1", "skipped", "already_processed"), ("c", "3", "processed", None)} <= reasons
    # A move whose file fails leaves the old place until it succeeds.
    store.run(on_disk(spark, "p/a/1", "p/a/2", "p/d/3", "p/a/4"), chunker("v3", ["3"]))
    assert counts(store)[-1] == (4, 0, 0, 3, 1, 0) and ("c", "3", "3x", "v2x") in stored(store)
    store.run(on_disk(spark, "p/a/1", "p/a/2", "p/d/3", "p/a/4"), chunker("v4"))
    assert counts(store)[-1] == (4, 1, 1, 3, 0, 1) and {r[0] for r in stored(store) if r[1] == "3"} == {"d"}
    small = store.compacted(str(tmp_path / "c"))
    assert stored(small) == stored(store) and small.last() == 1 and counts(small)[-1] == (4, 4, 0, 0, 0, 0)
    store.delete(spark.createDataFrame([("a", "1"), ("a", "9")], "collection string, pdf_filename string"))
    assert counts(store)[-1] == (0, 0, 0, 0, 0, 1) and {r[1] for r in stored(store)} == {"2", "3", "4"}
    store.run(on_disk(spark, "p/a/1"), chunker("v5"), reset=True)
    assert stored(store) == [("a", "1", "1x", "v5x"), ("a", "1", "1y", "v5y")]
    store.run(spark.createDataFrame([], FILES), chunker("v6"))
    assert stored(store) == [] and counts(store)[-1] == (0, 0, 0, 0, 0, 1)


@pytest.mark.parametrize("step,after", [("chunks", False), ("outcomes", False), ("commits", False), ("commits", True)])
def test_killed_between_steps(spark, tmp_path, step, after):
    before, now = on_disk(spark, "p/a/1", "p/a/2", "p/b/3"), on_disk(spark, "p/a/1", "p/c/2", "p/b/4")
    whole, store = ChunkStore(spark, str(tmp_path / "whole"), SCHEMA), ChunkStore(spark, str(tmp_path / "killed"), SCHEMA)
    for s in (whole, store):
        s.run(before, chunker("v1"))
    first = stored(store)
    whole.run(now, chunker("v2"))

    class Killed(Exception):
        pass

    class Fragile(ChunkStore):
        def write(self, name, gen, rows, *by):
            if name == step and not after:
                raise Killed
            out = super().write(name, gen, rows, *by)
            if name == step:
                raise Killed
            return out

    with pytest.raises(Killed):
        Fragile(spark, store.path, SCHEMA).run(on_disk(spark, "p/a/9", *(["p/c/2"] if step == "chunks" else [])) if step != "commits" else now, chunker("other", ["2"]) if step != "commits" else chunker("v2"))
    ended = step == "commits" and after
    assert stored(store) == (stored(whole) if ended else first)
    if not ended:
        store.run(now, chunker("v2"))
    assert stored(store) == stored(whole) and counts(store) == counts(whole)


def test_null_names(spark, tmp_path):
    store, files = ChunkStore(spark, str(tmp_path / "s"), SCHEMA), spark.createDataFrame([(None, "1", "p/1"), ("a", None, "p/2")], FILES)
    store.run(files, chunker("v1"))
    store.run(files, chunker("v2"))
    assert counts(store) == [(2, 2, 0, 0, 0, 0), (2, 0, 0, 2, 0, 0)]
    assert {(r.collection, r.pdf_filename, r.content[:2]) for r in store.chunks().collect()} == {(None, "1", "v1"), ("a", None, "v1")}
