"""Document fingerprints: threshold-scaled sketches, with DataFrame and SQL functions only.

A fingerprint holds every hash of a five-word shingle that lies below 1/`SCALE` of the hash range,
as sorted hexadecimal numbers: the first 16 digits of the MD5 of its words with one space between, which SQL has too. As the threshold is the same for all texts, fingerprints can be
merged by union, and the share of one in another estimates containment however unequal the texts.
Where one of two fingerprints holds fewer than `SMALL` hashes, as those of short texts do, the texts are compared
by all their shingles instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SHINGLE_WORDS, SCALE = 5, 4
#: Hashes below which a fingerprint is too small to compare by.
SMALL = 8
#: Neighbouring documents in a bucket when the table is dealt by doc_id, buckets in a group of them, and the square root of
#: the ranges with about as many rows each that the buckets are made in.
BUCKET, FANOUT, ROOT = 256, 1024, 32


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w) - words + 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, 16))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(each)

    return F.transform(F.array(tokens), of)[0]


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The shingle hashes below the threshold, sorted."""
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text, words), lambda h: h < F.lit(f"{(1 << 64) // scale:016x}"))))


def printed(hashes: Column) -> Column:
    return F.array_join(hashes, ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of all hashes of both that both have; two equal sets are alike even if empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).otherwise(F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(1.0))).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has; 1 if a has none."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(1.0)).cast("double")


def compared(by, a: Column, b: Column, a_text: Column, b_text: Column, words: int = SHINGLE_WORDS) -> Column:
    """`by` of two sketches, or of all the texts' shingles where a sketch is small; 1 for equal texts."""
    every = lambda text: F.array_distinct(shingle_hashes(text, words))
    return F.when(a_text == b_text, 1.0).when(F.least(F.size(a), F.size(b)) < SMALL, by(every(a_text), every(b_text))).otherwise(by(a, b))


def dealt(docs: DataFrame, bucket: int = BUCKET, root: int = ROOT) -> DataFrame:
    """The rows dealt by `_bucket`, a range of doc_id that holds about `bucket` rows; -1 for a null.

    Quantiles cut the ids into `root` squared ranges of about as many rows, whatever gaps the ids have; each of these is cut
    evenly into its buckets. The driver holds the quantiles only.
    """
    ranges = root * root
    low, high, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], F.lit(10 * ranges))).first()
    inner = max(1, -(-n // (ranges * bucket)))
    starts = sorted({low or 0, *(cuts or [])})
    # As many starts as a square has, so that one is found by two short searches.
    starts += [(1 << 63) - 1] * (ranges - len(starts))
    id_ = F.col("doc_id")
    coarse, fine = F.lit([float(x) for x in starts[::root]]), F.lit([float(x) for x in starts])
    among = lambda array: F.size(F.filter(array, lambda x: x <= F.col("_id")))
    rows = docs.withColumn("_id", id_.cast("double")).withColumn("_c", F.greatest(F.lit(1), among(coarse)))
    rows = rows.withColumn("_r", (F.col("_c") - 1) * root + F.greatest(F.lit(1), among(F.slice(fine, (F.col("_c") - 1) * root + 1, root))))
    ends = F.lit([float(x) for x in [*starts[1:], (1 << 63) - 1]])
    begin, end = F.element_at(fine, F.col("_r")), F.least(F.element_at(ends, F.col("_r")), F.lit(float(high or 0)) + 1.0)
    inside = F.floor((F.col("_id") - begin) / F.greatest(end - begin, F.lit(1.0)) * inner)
    place = F.col("_r").cast("long") * inner + F.least(F.lit(inner - 1).cast("long"), F.greatest(F.lit(0).cast("long"), inside))
    return rows.withColumn("_bucket", F.coalesce(F.when(id_.isNotNull(), place), F.lit(-1).cast("long"))).drop("_id", "_c", "_r").repartition("_bucket")


def after_bucket(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(_b, _after): for each bucket the text of the first row, by (doc_id, text), after its last row.

    That is the first row of the next bucket that has any; it is found over the buckets' first rows,
    dealt to groups of `fanout` buckets, and for the last bucket of a group over the numbers of the groups.
    After the last row comes the first.
    """
    firsts = rows.groupBy("_bucket").agg(F.min_by("text", F.struct("doc_id", "text")).alias("_first")).withColumn("_group", F.floor(F.col("_bucket") / fanout))
    firsts = firsts.withColumn("_inside", F.lead("_first").over(Window.partitionBy("_group").orderBy("_bucket")))
    heads = firsts.groupBy("_group").agg(F.min_by("_first", "_bucket").alias("_beyond"))
    ends = Window.orderBy("_group")
    whole = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Numbers only pass through the one task that orders the groups; their texts are joined after it.
    order = firsts.select("_group").distinct().select("_group", F.coalesce(F.lead("_group").over(ends), F.first("_group").over(whole)).alias("_then"))
    groups = order.join(heads.withColumnRenamed("_group", "_then"), "_then").select("_group", "_beyond")
    return firsts.join(groups, "_group").select(F.col("_bucket").alias("_b"), F.coalesce("_inside", "_beyond").alias("_after"))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document by doc_id, null first and ties by text; the last one takes
    from the first, and a single document from itself. A null text is empty and so is its
    fingerprint. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = dealt(slim)
    inside = Window.partitionBy("_bucket").orderBy("doc_id", "text")
    own = rows.withColumn("_sketch", sketch(F.col("text"), words, scale))
    own = own.withColumns({"_next": F.lead("text").over(inside), "_next_sketch": F.lead("_sketch").over(inside)})
    # Only the last row of a bucket looks beyond it.
    own = own.join(after_bucket(rows), (F.col("_bucket") == F.col("_b")) & F.col("_next").isNull(), "left")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = (
        own.withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("_next", F.coalesce("_next", "_after"))
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("_next", F.lit(1), quarter)))
        .select("doc_id", "n_chars", "text", "_edited", "_next", "_sketch", F.coalesce("_next_sketch", sketch(F.col("_after"), words, scale)).alias("_next_sketch"), F.sha2("_edited", 256).alias("edited_sha256"), sketch(F.col("_edited"), words, scale).alias("_edited_sketch"))
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("_sketch")).alias("fingerprint"), printed(F.col("_edited_sketch")).alias("edited_fingerprint"),
        compared(likeness, F.col("_sketch"), F.col("_edited_sketch"), F.col("text"), F.col("_edited"), words).alias("near_edited"),
        compared(likeness, F.col("_sketch"), F.col("_next_sketch"), F.col("text"), F.col("_next"), words).alias("near_next"),
        compared(containment, F.col("_sketch"), F.col("_edited_sketch"), F.col("text"), F.col("_edited"), words).alias("contained_in_edited"),
    )


#: The same in DuckDB, over the table `documents`.
ORACLE_SQL = r"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER w AS place, lead(coalesce(text, '')) OVER w AS following
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, coalesce(text, ''))
), paired AS (
  SELECT doc_id, text, length(text) AS n_chars, coalesce(following, (SELECT text FROM ordered WHERE place = 1)) AS following FROM ordered
), edited AS (
  SELECT *, substring(text, 1, n_chars - n_chars // 4) || substring(following, 1, n_chars // 4) AS changed FROM paired
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a, regexp_extract_all(changed, '[^\x20\x09-\x0D]+') AS b, regexp_extract_all(following, '[^\x20\x09-\x0D]+') AS c FROM edited
), hashed AS (
  SELECT *,
    [substring(md5(array_to_string(a[i : i + 4], ' ')), 1, 16) for i in range(1, CASE WHEN len(a) = 0 THEN 1 ELSE greatest(len(a) - 3, 2) END)] AS ha,
    [substring(md5(array_to_string(b[i : i + 4], ' ')), 1, 16) for i in range(1, CASE WHEN len(b) = 0 THEN 1 ELSE greatest(len(b) - 3, 2) END)] AS hb,
    [substring(md5(array_to_string(c[i : i + 4], ' ')), 1, 16) for i in range(1, CASE WHEN len(c) = 0 THEN 1 ELSE greatest(len(c) - 3, 2) END)] AS hc
  FROM words
), sketched AS (
  SELECT *, list_distinct([h for h in ha if h < '4']) AS sa, list_distinct([h for h in hb if h < '4']) AS sb, list_distinct([h for h in hc if h < '4']) AS sc FROM hashed
), chosen AS (
  SELECT *, CASE WHEN least(len(sa), len(sb)) < 8 THEN list_distinct(ha) ELSE sa END AS ea, CASE WHEN least(len(sa), len(sb)) < 8 THEN list_distinct(hb) ELSE sb END AS eb,
    CASE WHEN least(len(sa), len(sc)) < 8 THEN list_distinct(ha) ELSE sa END AS na, CASE WHEN least(len(sa), len(sc)) < 8 THEN list_distinct(hc) ELSE sc END AS nc
  FROM sketched
), common AS (
  SELECT *, len(list_intersect(ea, eb)) AS ie, len(list_intersect(na, nc)) AS n FROM chosen
)
SELECT doc_id, n_chars, sha256(changed) AS edited_sha256, array_to_string(list_sort(sa), ',') AS fingerprint, array_to_string(list_sort(sb), ',') AS edited_fingerprint,
  CASE WHEN text = changed OR len(ea) + len(eb) = 0 THEN 1.0 ELSE ie::DOUBLE / (len(ea) + len(eb) - ie) END AS near_edited,
  CASE WHEN text = following OR len(na) + len(nc) = 0 THEN 1.0 ELSE n::DOUBLE / (len(na) + len(nc) - n) END AS near_next,
  CASE WHEN text = changed OR len(ea) = 0 THEN 1.0 ELSE ie::DOUBLE / len(ea) END AS contained_in_edited
FROM common
"""
