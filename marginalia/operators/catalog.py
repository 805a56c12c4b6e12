"""Collections, documents, ledgers and scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X


@dataclass(frozen=True)
class Scope:
    """What a question looks at; compiled to one condition, which Spark pushes to the scan."""

    chunk_type: str | None = None
    documents: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    pages: tuple[int, int] | None = None
    partial_titles: bool = False

    def condition(self) -> Column:
        tests = F.lit(True)
        if self.chunk_type:
            tests = tests & (F.col("chunk_type") == self.chunk_type)
        if self.documents:
            tests = tests & F.col("pdf_filename").isin(*self.documents)
        if self.sections:
            tests = tests & (X.any_of(X.partly_equal(F.col("toc_title"), F.lit(s)) for s in self.sections) if self.partial_titles else F.col("toc_title").isin(*self.sections))
        if self.pages:
            tests = tests & F.col("page_number").between(*self.pages)
        return tests

    @property
    def mode(self) -> str:
        return "page_range" if self.pages else "toc_section" if self.sections else "group" if len(self.documents) > 1 else "pdf" if self.documents else "collection"


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Counts for each collection; an empty section or page counts as a value, an empty document does not."""
    return chunks.groupBy("collection").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("chunk_type") == "child").alias("child_chunks"), F.count_if(F.col("chunk_type") == "parent").alias("parent_chunks"),
        F.countDistinct("page_number").alias("pages"), F.countDistinct("toc_title").alias("sections"), F.countDistinct(F.nullif("pdf_filename", F.lit(""))).alias("documents"),
        F.countDistinct("pdf_filename", "page_number").alias("document_pages"),
    )


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection", "pdf_filename").agg(F.count(F.lit(1)).alias("chunks"))


def available_documents(chunks: DataFrame) -> DataFrame:
    return chunks.filter("pdf_filename <> ''").select("collection", "pdf_filename").distinct()


def collections_listing(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.countDistinct("pdf_filename").alias("document_count"), F.count(F.lit(1)).alias("chunk_count"))


def sections_of_documents(chunks: DataFrame) -> DataFrame:
    """Titles of each document, trimmed, each with the page of its first chunk."""
    titled = chunks.withColumn("title", X.stripped(F.col("toc_title"))).filter("title <> ''")
    return titled.groupBy("pdf_filename", "title").agg(F.min_by("corrected_toc_page", "seq").alias("page"))


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(pdf_filename, section, child_id, parent_id, content, page_number): each child with the parent of its section whose `child_ids` hold it."""
    named = children.select(F.col("pdf_filename").alias("_p"), F.col("section").alias("_s"), F.col("chunk_id").alias("child_id"))
    # Children come to their section's parents, so that a parent's text is moved once, not once for each child.
    same = F.col("pdf_filename").eqNullSafe(F.col("_p")) & F.col("section").eqNullSafe(F.col("_s")) & F.array_contains("child_ids", F.col("child_id"))
    return parents.join(named, same).select("pdf_filename", "section", "child_id", F.col("chunk_id").alias("parent_id"), "content", "page_number")


def collection_of_path(path: Column, root: str = "pdfs") -> Column:
    """The folder after the root as a slug; `default` for a file at the root or elsewhere."""
    found = F.regexp_extract(path, rf"(?:^|/){root}/([^/]+)/", 1)
    return F.when(found == "", "default").otherwise(X.slug(found))


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return files.join(ledger, ["collection", "pdf_filename"], "left_anti")


def moved_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger has under another collection only."""
    old = ledger.select(F.col("pdf_filename"), F.col("collection").alias("old_collection"))
    return new_files(files, ledger).join(old, "pdf_filename").filter("collection <> old_collection").select("pdf_filename", "collection", "old_collection")


def orphans(stored: DataFrame, files: DataFrame) -> DataFrame:
    return stored.join(files, ["collection", "pdf_filename"], "left_anti")


def outcomes(batch: DataFrame) -> DataFrame:
    return batch.groupBy("collection", "status").agg(F.count(F.lit(1)).alias("files"))


def valid_names(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Each requested document name and whether it is stored."""
    known = stored.select(F.col("pdf_filename").alias("k")).distinct()
    return requested.join(known, F.col("pdf_filename") == F.col("k"), "left").select("pdf_filename", F.col("k").isNotNull().alias("found"))


def best_path(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The path of each wanted file: in its collection's folder, else in that folder's other cases, any folder, the root."""
    f = files.select(F.col("pdf_filename").alias("f"), "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    c = F.col("collection")
    place = F.when(F.col("folder") == c, 1).when(F.col("folder") == F.initcap(c), 2).when(F.col("folder") == F.upper(c), 3).when(F.col("folder") != "pdfs", 4).otherwise(5)
    return wanted.join(f, F.col("pdf_filename") == F.col("f"), "left").groupBy("collection", "pdf_filename").agg(F.min(F.struct(place.alias("place"), "path"))["path"].alias("path"))


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after the documents of `fresh` replace their old rows; blank contents are left out."""
    kept = stored.join(fresh.select("collection", "pdf_filename").distinct(), ["collection", "pdf_filename"], "left_anti")
    return kept.unionByName(fresh.filter(F.col("content").rlike(r"\S")).select(*stored.columns))


def write_collections(chunks: DataFrame, path: str) -> None:
    """Writes whole documents; those of other collections and documents stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "pdf_filename").parquet(path)


def without_document(chunks: DataFrame, collection: str, document: str) -> DataFrame:
    """The chunks that stay when a document is deleted from a collection."""
    return chunks.filter(~(F.col("collection").eqNullSafe(F.lit(collection)) & F.col("pdf_filename").eqNullSafe(F.lit(document))))


def without_collection(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """The chunks that stay when a collection is dropped; none without a name."""
    return chunks.limit(0) if collection is None else chunks.filter(~F.col("collection").eqNullSafe(F.lit(collection)))
