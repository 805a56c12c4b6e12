"""A store of chunks that batches of files keep in step with what is on disk, whatever step a batch fails at.

    plans/gen=g                 what the batch does with each place (collection, pdf_filename), on disk or stored
    chunks/gen=g/collection=c   the chunks of the files that it processed, and a row with `error` for each that failed
    outcomes/gen=g/status=s     what became of each place: processed, skipped, failed or removed
    commits/gen=g               one row, the batch's summary

A batch is a generation and counts once its row in `commits`, one file, is written: its last step. Until then readers see the batches before
it, and what a failed one left is written over by the next run. A document's chunks are those of its last processed generation, so that
replacing, moving and deleting take effect together. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.stages import SCHEMAS

PLACE = ["collection", "pdf_filename"]
SHAPES = {
    "plans": "collection STRING, pdf_filename STRING, path STRING, action STRING, reason STRING",
    "outcomes": "collection STRING, pdf_filename STRING, path STRING, reason STRING, gen INT, status STRING",
    "commits": "found BIGINT, processed BIGINT, moved BIGINT, skipped BIGINT, failed BIGINT, removed BIGINT, gen INT",
}


def at_place(other: DataFrame, *more: str) -> tuple[DataFrame, object]:
    """The other side of a join by place with its columns renamed, and the condition; nulls meet nulls."""
    keys = [*PLACE, *more]
    renamed, same = other.withColumnsRenamed({k: f"_{k}" for k in keys}), F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return renamed, same


class ChunkStore:
    """The store in one folder; `schema` is that of its chunks and has collection, pdf_filename and content."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMAS["chunks"]):
        self.spark, self.path = spark, path.rstrip("/")
        self.shape = spark.createDataFrame([], schema)
        self.shapes = SHAPES | {"chunks": f"{schema}, error STRING, gen INT"}

    def table(self, name: str, last: int | None = None) -> DataFrame:
        """The rows of committed generations, or of those up to `last`."""
        try:
            rows = self.spark.read.schema(self.shapes[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was ever written to it
            rows = self.spark.createDataFrame([], self.shapes[name])
        return rows.filter(F.col("gen") <= (self.last() if last is None else last))

    def last(self) -> int:
        """The number of the last committed generation; 0 before the first."""
        try:
            return self.spark.read.schema(SHAPES["commits"]).parquet(f"{self.path}/commits").agg(F.max("gen")).first()[0] or 0
        except AnalysisException:
            return 0

    def live(self, last: int | None = None) -> DataFrame:
        """(collection, pdf_filename, gen): the documents in the store and the generation that holds their chunks."""
        done = self.table("outcomes", last).filter(F.col("status").isin("processed", "removed"))
        return done.groupBy(*PLACE).agg(F.max_by("status", "gen").alias("status"), F.max("gen").alias("gen")).filter("status = 'processed'").drop("status")

    def chunks(self) -> DataFrame:
        last = self.last()
        documents, same = at_place(self.live(last), "gen")
        return self.table("chunks", last).filter("error is null").join(documents, same, "left_semi").drop("error", "gen")

    def summaries(self) -> DataFrame:
        """One row for each batch: files found, processed, moved among these, skipped, failed, and places removed."""
        return self.table("commits")

    def plan(self, files: DataFrame, reset: bool = False) -> DataFrame:
        """One row for each file of `files` (collection, pdf_filename, path) and each stored document without a file.

        Files that the store has, and those of the same name and collection as one with a lesser path, are skipped; others are processed.
        A document whose file is gone is removed: as moved where a file of its name is processed for another collection, else as an orphan.
        One that still has its file stays, so that a name may be in several collections. With `reset` all files are processed.
        """
        first = files.groupBy(*PLACE).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
        stored, same = at_place(self.live())
        both = first.withColumn("_here", F.lit(True)).join(stored.select("_collection", "_pdf_filename", F.lit(True).alias("_known")), same, "full_outer")
        here, known = F.col("_here").isNotNull(), F.col("_known").isNotNull() & F.lit(not reset)
        key = lambda c: F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        action = F.when(here & ~known, "process").when(here, "skip").otherwise("remove").alias("action")
        placed = both.select(key("collection"), key("pdf_filename"), "path", "n", action)
        coming = placed.filter("action = 'process'").groupBy("pdf_filename").agg(F.lit(True).alias("_moved")).withColumnRenamed("pdf_filename", "_name")
        reasoned = placed.join(coming, (F.col("action") == "remove") & F.col("pdf_filename").eqNullSafe(F.col("_name")), "left")
        reason = F.when(F.col("action") == "skip", "already_processed").when(F.col("action") == "remove", F.when(F.col("_moved"), "moved").otherwise("orphan"))
        one = reasoned.select(*PLACE, "path", "action", reason.alias("reason"))
        twins, same = at_place(first.filter("n > 1").select(*PLACE, F.col("path").alias("_first")))
        again = files.join(twins, same).filter("path > _first").select(*PLACE, "path", F.lit("skip").alias("action"), F.lit("already_processed").alias("reason"))
        return one.unionByName(again)

    def write(self, name: str, gen: int, rows: DataFrame, *by: str) -> DataFrame:
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}/gen={gen}")
        return self.spark.read.schema(self.shapes[name]).parquet(f"{self.path}/{name}/gen={gen}")

    def run(self, files: DataFrame, process: Callable[[DataFrame], DataFrame], reset: bool = False) -> int:
        """One batch; the number of its generation.

        `process` makes chunks of the planned files (collection, pdf_filename, path); columns that it lacks are null, others are left out, and
        so are blank contents. A row with a text in `error`, a column that it may have, says that its file failed: such a file is tried again
        by the next batch, and the place that it moved from stays until then.
        """
        gen = self.last() + 1
        plan = self.write("plans", gen, self.plan(files, reset))
        made = process(plan.filter("action = 'process'").select(*PLACE, "path"))
        error = F.col("error") if "error" in made.columns else F.lit(None)
        rows = self.shape.withColumn("error", F.lit(None).cast("string")).unionByName(made.withColumn("error", error.cast("string")), allowMissingColumns=True)
        kept = rows.filter(F.col("error").isNotNull() | F.col("content").rlike(r"\S")).select(*self.shape.columns, "error")
        written = self.write("chunks", gen, kept.hint("rebalance", "collection"), "collection")

        broken, same = at_place(written.filter("error is not null").groupBy(*PLACE).agg(F.min("error").alias("error")))
        tried = plan.join(broken, (F.col("action") == "process") & same, "left")
        status = F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "remove", "removed").when(F.col("error").isNull(), "processed").otherwise("failed")
        ended = tried.select(*PLACE, "path", F.coalesce("error", "reason").alias("reason"), status.alias("status"))
        fine = ended.filter("status = 'processed'").select(F.col("pdf_filename").alias("_name")).distinct()
        left = ended.filter("status = 'removed' and reason = 'moved'").join(fine, F.col("pdf_filename").eqNullSafe(F.col("_name")), "left_semi")
        outcomes = self.write("outcomes", gen, ended.filter("status <> 'removed' or reason <> 'moved'").unionByName(left), "status")

        old = outcomes.filter("status = 'removed' and reason = 'moved'").select(F.col("pdf_filename").alias("_name")).distinct().withColumn("_from", F.lit(True))
        told = outcomes.join(old, (F.col("status") == "processed") & F.col("pdf_filename").eqNullSafe(F.col("_name")), "left")
        count = lambda s: F.count_if(F.col("status") == s)
        self.write("commits", gen, told.agg(F.count_if(F.col("status") != "removed").alias("found"), count("processed").alias("processed"), F.count_if(F.col("_from")).alias("moved"), count("skipped").alias("skipped"), count("failed").alias("failed"), count("removed").alias("removed")))
        return gen

    def delete(self, documents: DataFrame) -> int:
        """The documents (collection, pdf_filename) go, as a batch that commits in the same way; those that aren't stored change nothing.
        The next batch processes their files again if they are still on disk."""
        gen = self.last() + 1
        named, same = at_place(documents.select(*PLACE).distinct())
        gone = self.live().join(named, same, "left_semi").select(*PLACE, F.lit(None).cast("string").alias("path"), F.lit("deleted").alias("reason"), F.lit("removed").alias("status"))
        outcomes = self.write("outcomes", gen, gone, "status")
        none = [F.lit(0).cast("bigint").alias(c) for c in ("found", "processed", "moved", "skipped", "failed")]
        self.write("commits", gen, outcomes.agg(F.count(F.lit(1)).alias("removed")).select(*none, "removed"))
        return gen

    def compacted(self, path: str) -> ChunkStore:
        """The live documents and their chunks as one generation in another folder: for a store of many batches."""
        out = ChunkStore(self.spark, path)
        out.shape, out.shapes = self.shape, self.shapes
        out.write("chunks", 1, self.chunks().withColumn("error", F.lit(None).cast("string")).hint("rebalance", "collection"), "collection")
        living, same = at_place(self.live(), "gen")
        rows = self.table("outcomes").filter("status = 'processed'").join(living, same, "left_semi").drop("gen")
        outcomes = out.write("outcomes", 1, rows, "status")
        none = [F.lit(0).cast("bigint").alias(c) for c in ("moved", "skipped", "failed", "removed")]
        out.write("commits", 1, outcomes.agg(F.count(F.lit(1)).alias("found")).select("found", F.col("found").alias("processed"), *none))
        return out
