"""A stored BM25 index: postings in buckets of terms, kept up to date by generations of changes.

    postings/gen=g/bucket=b   term, collection, pdf_filename, chunk_id, tf, length
    frequencies/gen=g/bucket=b   term, change (chunks that hold the term, more or fewer)
    chunks/gen=g              collection, pdf_filename, chunk_id, length
    gone/gen=g                collection, pdf_filename: what older generations say of these documents is void
    histogram/gen=g           df, terms: how many terms so many chunks hold, after the generation
    commits/gen=g             chunks, tokens after the generation

A generation counts once its row in `commits` is written, which is its last step: what a failed one left is written over by the
next, and readers never see it. A change reads the postings of the documents that it replaces only to take back their counts.
Queries scan the buckets of their terms, in all generations, without the documents that are gone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.retrieval import few, ranked, term_scores

#: Buckets of terms, and parts of one bucket that are written apart, so that a term of all chunks is not one task's.
BUCKETS, PARTS = 64, 8
DOCUMENT = ["collection", "pdf_filename"]
SHAPES = {
    "postings": "term STRING, collection STRING, pdf_filename STRING, chunk_id STRING, tf BIGINT, length BIGINT, gen INT, bucket INT",
    "frequencies": "term STRING, change BIGINT, gen INT, bucket INT",
    "chunks": "collection STRING, pdf_filename STRING, chunk_id STRING, length BIGINT, gen INT",
    "gone": "collection STRING, pdf_filename STRING, gen INT",
    "histogram": "df BIGINT, terms BIGINT, gen INT",
    "commits": "chunks BIGINT, tokens BIGINT, gen INT",
}


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class StoredBm25:
    """The index in one folder. A null content has no terms; a null collection or document name is a value like others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, last: int) -> DataFrame:
        """A table's rows of the generations up to `last`."""
        try:
            rows = self.spark.read.schema(SHAPES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was ever written to it
            rows = self.spark.createDataFrame([], SHAPES[name])
        return rows.filter(F.col("gen") <= last)

    def last(self) -> int:
        """The number of the last committed generation; 0 before the first."""
        try:
            return self.spark.read.schema(SHAPES["commits"]).parquet(f"{self.path}/commits").agg(F.max("gen")).first()[0] or 0
        except AnalysisException:
            return 0

    def alive(self, rows: DataFrame, last: int) -> DataFrame:
        """Rows of documents that no generation after their own, up to `last`, replaced or deleted."""
        latest = self.table("gone", last).groupBy(*DOCUMENT).agg(F.max("gen").alias("until")).select(F.col("collection").alias("_c"), F.col("pdf_filename").alias("_p"), "until")
        same = F.col("collection").eqNullSafe(F.col("_c")) & F.col("pdf_filename").eqNullSafe(F.col("_p")) & (F.col("gen") < F.col("until"))
        return rows.join(latest, same, "left_anti")

    def write(self, name: str, gen: int, rows: DataFrame, *by: str) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}/gen={gen}")

    def change(self, fresh: DataFrame, gone: DataFrame) -> int:
        """One generation: the documents of `gone` and of `fresh` go, then the chunks of `fresh` come. Blank contents are left out, as by an upsert."""
        last = self.last()
        gen = last + 1
        before_postings, before_chunks = self.alive(self.table("postings", last), last), self.alive(self.table("chunks", last), last)
        before_changes = self.table("frequencies", last)
        leaving = gone.select(*DOCUMENT).union(fresh.select(*DOCUMENT)).distinct()
        self.write("gone", gen, leaving)
        leaving = self.spark.read.schema("collection STRING, pdf_filename STRING").parquet(f"{self.path}/gone/gen={gen}")
        named = leaving.select(F.col("collection").alias("_c"), F.col("pdf_filename").alias("_p"))
        same = F.col("collection").eqNullSafe(F.col("_c")) & F.col("pdf_filename").eqNullSafe(F.col("_p"))

        terms = fresh.filter(F.col("content").rlike(r"\S")).select(*DOCUMENT, "chunk_id", X.tokens(F.col("content")).alias("t")).withColumn("length", F.size("t").cast("bigint"))
        self.write("chunks", gen, terms.select(*DOCUMENT, "chunk_id", "length"))
        each = terms.select(*DOCUMENT, "chunk_id", "length", F.explode("t").alias("term")).groupBy("term", *DOCUMENT, "chunk_id", "length").agg(F.count(F.lit(1)).alias("tf"))
        dealt = each.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
        self.write("postings", gen, dealt, "bucket")
        # Of a bucket that has no row in this generation there is no folder: the schema still reads the others.
        own = self.spark.read.schema("term STRING, bucket INT").parquet(f"{self.path}/postings/gen={gen}")
        old = before_postings.join(named, same, "left_semi").select("term", "bucket")
        change = own.withColumn("change", F.lit(1)).unionByName(old.withColumn("change", F.lit(-1))).groupBy("term", "bucket").agg(F.sum("change").alias("change")).filter("change <> 0")
        self.write("frequencies", gen, change.repartition("bucket"), "bucket")

        own_changes = self.spark.read.schema("term STRING, change BIGINT, bucket INT").parquet(f"{self.path}/frequencies/gen={gen}")
        df = before_changes.select("term", "change").union(own_changes.select("term", "change")).groupBy("term").agg(F.sum("change").alias("df")).filter("df > 0")
        self.write("histogram", gen, df.groupBy("df").agg(F.count(F.lit(1)).alias("terms")))
        own_chunks = self.spark.read.schema("collection STRING, pdf_filename STRING, chunk_id STRING, length BIGINT").parquet(f"{self.path}/chunks/gen={gen}")
        stay = before_chunks.join(named, same, "left_anti").select("length").union(own_chunks.select("length"))
        self.write("commits", gen, stay.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")))
        return gen

    def upsert(self, fresh: DataFrame) -> int:
        """The documents of `fresh` (collection, pdf_filename, chunk_id, content) replace their old rows."""
        return self.change(fresh, fresh.limit(0))

    def delete(self, documents: DataFrame) -> int:
        """The documents (collection, pdf_filename) go; those that are not there change nothing."""
        none = self.spark.createDataFrame([], "collection STRING, pdf_filename STRING, chunk_id STRING, content STRING")
        return self.change(none, documents)

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
        """(query_id, chunk_id, score, rank), as `retrieval.bm25` over the chunks that are alive. No rows without a generation.

        The buckets of the queries' terms, at most BUCKETS numbers, are looked at first and pushed to the scans.
        """
        none = self.spark.createDataFrame([], "query_id BIGINT, chunk_id STRING, score DOUBLE, rank INT")
        gen = self.last()
        if not gen:
            return none
        chunks, tokens = self.table("commits", gen).filter(F.col("gen") == gen).select("chunks", "tokens").first()
        asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        buckets = [r[0] for r in asked.select(bucket_of(F.col("term"))).distinct().collect()]
        if not chunks or not tokens or not buckets:
            return none
        weight = lambda df: F.log(F.lit(float(chunks)) - df + 0.5) - F.log(df + 0.5)
        of_all = self.table("histogram", gen).filter(F.col("gen") == gen).agg(F.sum(F.col("terms") * weight(F.col("df").cast("double"))) / F.sum("terms")).first()[0]
        terms = few(asked.select("term").distinct())
        df = self.table("frequencies", gen).filter(F.col("bucket").isin(*buckets)).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("change").cast("double").alias("df")).filter("df > 0")
        weights = df.select("term", weight(F.col("df")).alias("raw")).select("term", F.when(F.col("raw") < 0, floor * of_all).otherwise(F.col("raw")).alias("idf"))
        postings = self.alive(self.table("postings", gen).filter(F.col("bucket").isin(*buckets)).join(terms, "term", "left_semi"), gen)
        dealt = postings.select(*DOCUMENT, "chunk_id", "term", "tf", "length").repartition("chunk_id")
        scores = term_scores(dealt, asked, weights, tokens / chunks, [*DOCUMENT, "chunk_id"], k1, b)
        return ranked(scores.select("query_id", "chunk_id", "score"), k, "score", ["query_id"])

    def compacted(self, path: str) -> StoredBm25:
        """The same index with one generation, in another folder: for one whose generations have become many."""
        out, last = StoredBm25(self.spark, path), self.last()
        out.write("gone", 1, self.table("gone", 0).select(*DOCUMENT))
        out.write("chunks", 1, self.alive(self.table("chunks", last), last).drop("gen"))
        postings = self.alive(self.table("postings", last), last).drop("gen")
        out.write("postings", 1, postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))), "bucket")
        changes = self.table("frequencies", last).groupBy("term", "bucket").agg(F.sum("change").alias("change")).filter("change > 0")
        out.write("frequencies", 1, changes.repartition("bucket"), "bucket")
        for name in ("histogram", "commits"):
            out.write(name, 1, self.table(name, last).filter(F.col("gen") == last).drop("gen"))
        return out
