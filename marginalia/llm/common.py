"""Shared helpers of the training-data operators: sessions, tables and byte-level text arrays."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A pseudorandom 64-bit value for each byte, for polynomial hashes.
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(context) -> str:
    """A folder for tests on one machine; on a cluster nobody else would see it, so one has to be named."""
    if not context.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one in spark.checkpoint.dir; one is set here only where the session
    names none, as in tests on one machine.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or _own_folder(context))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


_tables = 0


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, for tables that cut lineage."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        spark.sparkContext.setCheckpointDir(_own_folder(spark.sparkContext))
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm_dir.get()


def written(df: DataFrame, key: str | None = None, parts: int = 1, dealt: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder, with its lineage cut; with a key, bucketed by it, so
    that joins and groupings by the key don't move its rows; `dealt` says that the rows are dealt by the key
    to a number of partitions of which `parts` is a divisor. The folder goes when the session's process ends."""
    global _tables
    spark = df.sparkSession
    _tables += 1
    name = f"cut_{os.getpid()}_{uuid.uuid4().hex[:12]}_{_tables}"
    path = f"{shared_folder(spark)}/{name}"
    atexit.register(_remove, spark, path)
    if key is None:
        df.write.option("compression", "zstd").parquet(path)
        found = spark.read.parquet(path)
    else:
        (df if dealt else df.repartition(parts, key)).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts, key).sortBy(key).saveAsTable(name)
        found = spark.table(name)
    found._cut = (path, name if key else None)
    return found


def discarded(*tables: DataFrame) -> None:
    """Removes tables that `written` made, once all that was made of them is written too. The driver's garbage collection
    after it lets Spark's cleaner remove the shuffle files of ended queries, on all executors."""
    spark = tables[0].sparkSession
    for table in tables:
        path, name = table._cut
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended first; the folder's owner clears it
        pass


def learned(column: Column, modulus: int, left_out: int) -> Column:
    """True where crc32(column as text) modulo `modulus` isn't `left_out`; a null counts as learned."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus != left_out, F.lit(True))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of an Arrow string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches, column: str, most_bytes: int = 4 << 20):
    """Slices of the record batches whose texts hold about `most_bytes` together, so that work arrays
    stay small; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + most_bytes, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper * np.uint8(32)).astype(np.uint8)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word's number for each row (one more than rows)."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    borders = at[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    begins[borders] = inside[1:-1][borders]
    ends[borders - 1] = inside[1:-1][borders - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n-1, modulo 2**64."""
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_kept_powers = {"up": powers(1), "down": powers(1)}
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_kept_powers["up"]) < n:
        size = (n + (1 << 18)) >> 18 << 18
        _kept_powers["up"] = powers(size)
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        _kept_powers["down"] = np.multiply.accumulate(down)
    return _kept_powers["up"], _kept_powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs stay equal, all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of one running polynomial."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, joined."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def spans_of(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin .. begin+count-1 for each, joined."""
    return np.repeat(np.asarray(begin, np.int64), counts) + ranges(counts)


def cpu_local_dir() -> str:
    """A folder for this task's own spill files, under the executor's temp folder; its user removes it."""
    return tempfile.mkdtemp(prefix="spill-", dir=os.environ.get("TMPDIR") or None)
