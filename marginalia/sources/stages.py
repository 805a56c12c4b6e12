"""Stage files: explicit schemas, JSON and Parquet sources and sinks, and the scan for new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "STRUCT<x0:DOUBLE,y0:DOUBLE,x1:DOUBLE,y1:DOUBLE>"
SCHEMAS = {
    "text_spans": f"pdf_filename STRING, page_number INT, line_order INT, text STRING, bbox {BOX}, font_name STRING, font_size DOUBLE, font_weight STRING, font_style STRING",
    "figures": f"pdf_filename STRING, page_number INT, bbox {BOX}, caption STRING, image_type STRING",
    "tables": f"pdf_filename STRING, page_number INT, bbox {BOX}, grid_data ARRAY<ARRAY<STRING>>, markdown STRING, caption STRING",
    "footnotes": f"pdf_filename STRING, page_number INT, bbox {BOX}, text STRING, reference_number STRING",
    "paragraphs": "pdf_filename STRING, page_number INT, paragraph_index INT, text STRING, estimated_y_position DOUBLE",
    "layout_pages": f"pdf_filename STRING, page_number INT, full_page_text STRING, column_geometry STRUCT<column_count:INT,column_gaps:ARRAY<DOUBLE>,page_bbox:{BOX}>",
    "toc_entries": "pdf_filename STRING, ord INT, title STRING, page_number INT, level INT, source_page INT",
    "blocks": f"pdf_filename STRING, ord INT, block_type STRING, content STRING, bbox {BOX}, page_number INT, toc STRUCT<toc_title:STRING,toc_level:INT,toc_page:INT,corrected_toc_page:INT,is_toc_heading:BOOLEAN>",
    "chunks": "collection STRING, pdf_filename STRING, chunk_id STRING, chunk_type STRING, content STRING, embedding ARRAY<FLOAT>, page_id STRING, page_type STRING, page_title STRING, section_title STRING, page_number INT, original_page_numbers ARRAY<INT>, chunk_index INT, token_count INT, pdf_path STRING, toc_title STRING, toc_level INT, corrected_toc_page INT, child_chunk_ids ARRAY<STRING>",
    "turns": "collection STRING, ord INT, ts TIMESTAMP, mode STRING, user_message STRING, assistant_response STRING, retrieved_chunks INT, is_cleared BOOLEAN, is_summary BOOLEAN, is_summarized BOOLEAN, summarized_count INT",
    "ledger": "collection STRING, pdf_filename STRING",
    "files": "path STRING, pdf_filename STRING, size BIGINT",
}


def read_stage(spark: SparkSession, stage: str, path: str, form: str = "json") -> DataFrame:
    """A stage's rows by its schema; a malformed record fails the read instead of passing as nulls."""
    reader = spark.read.schema(SCHEMAS[stage])
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.parquet(path)


def write_stage(df: DataFrame, path: str, form: str = "json") -> None:
    (df.write.json if form == "json" else df.write.parquet)(path)


def files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, pdf_filename, size) of all files below the root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("pdf_filename"), F.col("length").alias("size"))
