"""Chunk files taken in as they arrive: a file source with a checkpoint, and an upsert by document for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.stages import SCHEMAS


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, ledger: str | None = None) -> StreamingQuery:
    """Takes in all chunk files that are new since the checkpoint, then stops.

    A document's rows are replaced as a whole, so that a batch that is run again after a failure
    leaves the same store; blank contents are left out. The ledger gets each document taken in.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.filter("content rlike '\\\\S'")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "pdf_filename").parquet(store)
        if ledger:
            rows.select("collection", "pdf_filename").distinct().write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    stream = spark.readStream.schema(SCHEMAS["chunks"]).json(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
