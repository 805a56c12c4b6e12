"""Views of the input tables in the shapes that the operators take. Deterministic; documented in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("seq", F.floor(F.col("doc_id") / 20).cast("bigint"))
    page = F.col("seq") % 50 + 1
    tens = F.floor(page / 10).cast("bigint")
    out = d.select(
        F.col("lang").alias("collection"), F.col("source").alias("pdf_filename"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "doc_id", "seq", F.col("text").alias("content"), page.alias("page_number"),
        F.when(F.col("seq") % 5 == 0, "parent").otherwise("child").alias("chunk_type"), F.concat(F.lit("Section "), tens).alias("toc_title"), F.greatest(F.lit(1), tens * 10).cast("bigint").alias("corrected_toc_page"),
    )
    if not vectors:
        return out
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return out.join(e, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")


def queries(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.first_words(F.col("text"), 3).alias("query"))
    if not vectors:
        return q
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return q.join(e, F.col("query_id") == F.col("vec_id")).drop("vec_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_message"))
    reply = c.filter("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("assistant_response"))
    return user.join(reply, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select(F.concat(F.lit("c"), F.col("conv_id") % 5).alias("collection"), "conv_id", "turn", "user_message", "assistant_response")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.select(F.col("source").alias("pdf_filename"), "doc_id", F.col("line").cast("bigint").alias("line"), "content", (F.floor(F.col("doc_id") / 20) % 50 + 1).cast("bigint").alias("page_number"), (F.lit(72.0) + F.col("line") * 12.0).alias("y0"))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, the first document of each group of ten pages gives an entry."""
    c = chunks(spark, sf_dir, False)
    first = c.groupBy("pdf_filename", "toc_title").agg(F.min(F.struct("page_number", "doc_id", F.substring("content", 1, 40).alias("start"))).alias("f"))
    return first.select("pdf_filename", F.concat("toc_title", F.lit(" "), "f.start").alias("title"), F.col("f.page_number").alias("page_number"), (F.length("toc_title") % 3 + 1).cast("bigint").alias("level"), F.col("f.doc_id").alias("ord"))
