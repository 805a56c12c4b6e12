"""Suffix-array removal of byte strings that are found elsewhere, over a whole table.

Each text is cut into overlapping segments by the least hash among the 32-byte strings of every
400-byte window: windows in a row with the same least hash are one segment, and equal windows have
equal least hashes, so all places of a repeated string lie in segments of one hash. Hashes found once
hold no repeat. The distinct segments of the others are dealt to shards by hash, and each shard is
sorted as one string by external induced sorting; neighbours that share 400 bytes, or a segment that
stands for several, give the repeated windows. Their spans go back to all places of each segment.

A hash whose segments are more than a shard's bytes, as that of a very common string, is split: its segments are cut
again by further, independent least hashes of the same windows, one for each time that the bytes exceed
a shard's twofold, and windows are sorted with those that agree in all of them. Equal pieces are one string that stands for all their
places before any bytes move, so a passage of very many texts is sorted once. Where the distinct pieces of a part are
still beyond a shard, as those that begin in one of many texts and end in what they share, the part is cut into its windows; those
found once go, and one of each other is left. Only windows that are all different and all repeated can still exceed
a shard; they are sorted in rooms, two at a time.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODE, _power_tables, checkpointed, mixed, pieces, span_hashes, unused, utf8, written
from .induced import Room, descending

#: Bytes of a string that counts, of the strings whose hashes place segments, and of a shard about.
LENGTH, GRAM, SHARD_BYTES = 400, 32, 3 << 19
#: Memory for one shard's tuples, less than those of an ordinary shard take; what goes beyond is on disk.
MEMORY = 4 << 20

SEGMENTS = "h bigint, seg bigint, key binary, start int, stop int, copies bigint, twice boolean"


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the `gram` bytes from each place on."""
    n = len(raw)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up[:n], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def least_of(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` hashes in a row."""
    least, size = h, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    return least


def segments(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each segment: its least hash, where it begins and ends, its text, and whether the hash is in it twice."""
    window = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    h = gram_hashes(raw, gram)
    least = least_of(h, window)
    doc = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - length + 1, 0))
    places = np.maximum(np.diff(at) - length + 1, 0)
    start = np.repeat(at[:-1], places) + np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places)
    if not len(start):
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    first, last, key = start[head], start[tail], value[head]
    twice = np.zeros(len(head), bool)
    lanes = np.arange(window)
    for k in range(0, len(head), 2048):
        part = slice(k, k + 2048)
        left = (h[first[part, None] + lanes] == key[part, None]).argmax(axis=1) + first[part]
        right = window - 1 - (h[last[part, None] + lanes] == key[part, None])[:, ::-1].argmax(axis=1) + last[part]
        twice[part] = left != right
    return key, first, last + length, doc[head], twice


def _segment_rows(batches, length: int, gram: int):
    for part in pieces(batches, "text", 2 << 20):
        raw, at = utf8(part.column(1))
        h, start, stop, doc, twice = segments(raw, at, length, gram)
        if not len(h):
            continue
        keys = part.column(0).take(pa.array(doc))
        seg = span_hashes(raw, start, stop)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), keys, pa.array((start - at[doc]).astype(np.int32)), pa.array((stop - at[doc]).astype(np.int32)), part.column(2).take(pa.array(doc)), pa.array(twice)],
            names=["h", "seg", "key", "start", "stop", "copies", "twice"],
        )


def parted(raw: np.ndarray, levels: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment cut by `levels` further least hashes of its windows: a key, begin and end for each part."""
    h, key = gram_hashes(raw, gram), np.zeros(len(raw) - length + 1, np.uint64)
    for level in range(1, levels + 1):
        key = mixed(key + least_of(mixed(h + np.uint64(level)), length - gram + 1))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head], head, np.append(head[1:], len(key)) - 1 + length


#: Tasks that the pieces of one string are dealt to when its spans go back to them.
SALTS = 32

PIECES = "part bigint, piece bigint, h bigint, seg bigint, at int, weight bigint, key binary, start int, stop int"


def _segments_of(part):
    """Bytes, segments (as columns) and, for each segment, the text's number and where it begins; rows (.., text, segments)."""
    raw, at = utf8(part.column(part.schema.get_field_index("text")))
    lists = part.column(part.schema.get_field_index("segments"))
    counts = np.diff(lists.offsets.to_numpy())
    return raw, lists.flatten(), np.repeat(np.arange(len(counts)), counts), np.repeat(at[:-1], counts)


def windows(raw: np.ndarray, levels: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of a piece by itself, as `parted`: its key is made of all its bytes, half of them at a time."""
    begin = np.arange(len(raw) - length + 1)
    key = mixed(span_hashes(raw, begin, begin + length // 2) + np.uint64(1)) ^ span_hashes(raw, begin + length // 2, begin + length)
    return key, begin, begin + length


def _piece_rows(batches, length: int, gram: int, how):
    """The pieces of the segments of large groups, without bytes: rows of `PIECES`, from rows (key, text, segments: array of
    (h, seg, weight, levels, start, stop)); `how` is `parted` or `windows`."""
    for part in pieces(batches, "text"):
        raw, inner, doc, base = _segments_of(part)
        start, stop = inner.field("start").to_numpy() + base, inner.field("stop").to_numpy() + base
        h, levels = inner.field("h").to_numpy(), inner.field("levels").to_numpy()
        owner, keys, begin, end = ([np.zeros(0, np.int64)] for _ in range(4))
        for k in range(len(h)):
            key, a, b = how(raw[start[k] : stop[k]], int(levels[k]), length, gram)
            owner.append(np.full(len(key), k)), keys.append(mixed(key ^ h[k : k + 1].view(np.uint64)).view(np.int64))
            begin.append(a + start[k]), end.append(b + start[k])
        owner, keys, begin, end = (np.concatenate(x) for x in (owner, keys, begin, end))
        own = [inner.field(c).take(pa.array(owner)) for c in ("h", "seg", "weight")]
        at, first, last = (pa.array(x.astype(np.int32)) for x in (begin - start[owner], begin - base[owner], end - base[owner]))
        columns = [pa.array(keys), pa.array(span_hashes(raw, begin, end).view(np.int64)), *own[:2], at, own[2], part.column(0).take(pa.array(doc[owner])), first, last]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "piece", "h", "seg", "at", "weight", "key", "start", "stop"])


CUT = "part bigint, h bigint, seg bigint, at int, weight bigint, bytes binary"


def _cut(batches):
    """The bytes of each segment of each text; rows (text, segments: array of (h, seg, weight, start, stop))."""
    for part in pieces(batches, "text"):
        raw, inner, _, base = _segments_of(part)
        begin, end = inner.field("start").to_numpy() + base, inner.field("stop").to_numpy() + base
        data = raw.tobytes()
        cut = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
        h = inner.field("h")
        yield pa.RecordBatch.from_arrays([h, h, inner.field("seg"), pa.array(np.zeros(len(h), np.int32)), inner.field("weight"), cut], names=["part", "h", "seg", "at", "weight", "bytes"])


def repeated_windows(parts: list[bytes], weight: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (segment, begin, end) of the bytes covered by windows found twice or more.

    parts: distinct strings, each standing for `weight` places; all of them are sorted as one string.
    """
    sizes = np.array([len(x) for x in parts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(base[-1] + 1, np.int16)
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text[:-1] = joined
    text[:-1] += 2
    text[base[1:] - 1] = 1
    marked = np.zeros(len(text) + 1, bool)
    for k in np.flatnonzero(weight > 1):
        marked[base[k] : base[k] + sizes[k] - length + 1] = True
    with Room(memory) as room:
        before = np.zeros(0, np.int32)
        for position, shared in descending(text, 258, length, room):
            hit = np.flatnonzero(shared >= length)
            if len(hit):
                marked[position[hit]] = True
                inner = hit[hit > 0]
                marked[position[inner - 1]] = True
                if hit[0] == 0:
                    marked[before] = True
            before = position[-1:]
    # A suffix that begins too near its part's end may share a separator with others.
    marked[:-2] &= np.repeat(base[1:] - 1, sizes + 1) - np.arange(base[-1]) >= length
    marked[-2:] = False
    step = np.diff(np.concatenate(([False], marked[: len(text)], [False])).astype(np.int8))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1 + length
    owner = np.searchsorted(base, begin, "right") - 1
    return owner, begin - base[owner], end - base[owner]


FOUND = "h bigint, seg bigint, spans array<struct<a:int,b:int>>"


def repeats_in_rooms(parts: list[bytes], weight: np.ndarray, length: int, memory: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `repeated_windows`, for strings of any size together: beyond `most_bytes` they are dealt to rooms of half as
    many bytes and each two rooms are sorted together, so that two equal windows always meet."""
    upto = np.cumsum([len(x) for x in parts])
    if upto[-1] <= most_bytes:
        return repeated_windows(parts, weight, length, memory)
    rooms = [np.flatnonzero(upto // (most_bytes // 2) == r) for r in range(upto[-1] // (most_bytes // 2) + 1)]
    rooms = [r for r in rooms if len(r)]
    found = []
    for i, one in enumerate(rooms):
        for other in rooms[i + 1 :]:
            both = np.concatenate((one, other))
            owner, begin, end = repeated_windows([parts[k] for k in both], weight[both], length, memory)
            found.append(np.stack((both[owner], begin, end)))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if len(rooms) > 1 else repeated_windows(parts, weight, length, memory)


def _sort_shards(batches, length: int, memory: int, shard_bytes: int):
    """Rows come sorted by part; all of one part go to the same shard, and as many parts as its bytes allow."""
    held: list[tuple] = []

    def flush(rows):
        _, hashes, segs, ats, weights, parts = zip(*rows)
        owner, begin, end = repeats_in_rooms(list(parts), np.array(weights), length, memory, 2 * shard_bytes if len(parts) < 2 else shard_bytes)
        keep, counts = np.unique(owner, return_counts=True)
        shift = np.repeat(np.array(ats, np.int64)[keep], counts)
        spans = pa.StructArray.from_arrays([pa.array((begin + shift).astype(np.int32)), pa.array((end + shift).astype(np.int32))], names=["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), spans)
        return pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.int64)[keep]), pa.array(np.array(segs, np.int64)[keep]), lists], names=["h", "seg", "spans"])

    part, size, own = [], 0, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if part and row[0] != part[-1][0]:
                if held and size + own > shard_bytes:
                    yield flush(held)
                    held, size = [], 0
                held += part
                size, part, own = size + own, [], 0
            part.append(row)
            own += len(row[-1])
    if held and part and size + own > shard_bytes:
        yield flush(held)
        held = []
    if held + part:
        yield flush(held + part)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans' union; spans that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return begin[head], reach[np.append(head[1:], len(begin)) - 1]


def _rest(batches, digest: bool):
    """What remains of each text: rows (key, text, spans as a list or null)."""
    for part in pieces(batches, "text", 2 << 20):
        data = [(x or "").encode() for x in part.column(1).to_pylist()]
        lists = part.column(2)
        offsets, inner = lists.offsets.to_numpy(), lists.flatten()
        skip = int(offsets[0])
        a, b = inner.field("a").to_numpy(zero_copy_only=False), inner.field("b").to_numpy(zero_copy_only=False)
        rows = []
        for k, text in enumerate(data):
            i, j = int(offsets[k]) - skip, int(offsets[k + 1]) - skip
            if i == j or lists[k].as_py() is None:
                rows.append((len(text), 0, 0, text))
                continue
            begin, end = _union(a[i:j], b[i:j])
            keep = b"".join(text[p:q] for p, q in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
            rows.append((len(text), len(text) - len(keep), len(begin), keep))
        last = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]) if digest else pa.array([r[3].decode("utf-8", "ignore") for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), last], names=["key", "n_bytes", "n_removed", "n_spans", "rest"])


def strings_to_sort(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, list]:
    """Rows to sort (part, h, seg, at, weight, bytes), no two of a part equal; the places of segments (h, seg); and for each time
    that large groups were cut, the places (h, seg, at) of the pieces (part, piece), and the distinct pieces."""
    rows = texts.select("key", "text", "copies").mapInArrow(partial(_segment_rows, length=length, gram=gram), SEGMENTS)
    # One shuffle by the hash serves the count by hash, its bytes and the grouping of equal segments.
    own = Window.partitionBy("h")
    total, held = F.sum(F.col("copies") * F.when(F.col("twice"), 2).otherwise(1)).over(own), F.sum((F.col("stop") - F.col("start")).cast("long")).over(own)
    shared = rows.withColumns({"total": total, "levels": F.greatest(F.lit(0), F.ceil(F.log2(held / shard_bytes))).cast("int")}).filter("total > 1").drop("total", "twice")
    places = written(shared)
    first = F.min(F.struct("key", "start", "stop")).alias("first")

    def with_text(segs: DataFrame) -> DataFrame:
        fields = [c for c in segs.columns if c != "first"] + [F.col("first.start").alias("start"), F.col("first.stop").alias("stop")]
        return texts.select("key", "text").join(segs.groupBy("first.key").agg(F.collect_list(F.struct(*fields)).alias("segments")), "key")

    def cut_again(segs: DataFrame, how) -> tuple[DataFrame, DataFrame]:
        found = written(with_text(segs).mapInArrow(partial(_piece_rows, length=length, gram=gram, how=how), PIECES))
        return found, found.groupBy(F.col("part").alias("h"), F.col("piece").alias("seg")).agg(F.sum("weight").alias("weight"), first)

    whole = places.filter("levels = 0").groupBy("h", "seg").agg(F.sum("copies").alias("weight"), first)
    hot = places.filter("levels > 0").groupBy("h", "seg").agg(F.sum("copies").alias("weight"), F.max("levels").alias("levels"), first)
    cut_hot, merged = cut_again(hot, parted)
    large = written(merged.groupBy("h").agg(F.sum((F.col("first.stop") - F.col("first.start")).cast("long")).alias("held")).filter(F.col("held") > shard_bytes).select("h"))
    cut_large, alone = cut_again(merged.join(large, "h", "left_semi").withColumn("levels", F.lit(0)), windows)
    alone = alone.filter("weight > 1")
    distinct = whole.unionByName(merged.join(large, "h", "left_anti")).unionByName(alone)
    return with_text(distinct).select("text", "segments").mapInArrow(_cut, CUT), places, [(cut_hot, merged), (cut_large, alone)]


def covered_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans): the covered spans of each distinct text (key, text, copies) that has any; they may overlap."""
    spark = texts.sparkSession
    cut, places, steps = strings_to_sort(texts, length, gram, shard_bytes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = cut.repartition(parts, "part").sortWithinPartitions("part", "h", "seg", "at")
    found = written(shards.mapInArrow(partial(_sort_shards, length=length, memory=MEMORY, shard_bytes=shard_bytes), FOUND))
    for pieces_at, distinct in reversed(steps):
        # Spans go back to all places of a piece, salted, as it may have very many.
        many = found.join(distinct.select("h", "seg"), ["h", "seg"], "left_semi").select(F.col("h").alias("part"), F.col("seg").alias("piece"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
        back = pieces_at.withColumn("salt", F.pmod(F.xxhash64("h", "seg"), F.lit(SALTS)).cast("int")).join(many, ["part", "piece", "salt"])
        found = found.unionByName(back.select("h", "seg", moved.alias("spans")))
    spans = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return places.join(found, ["h", "seg"]).select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies) of the distinct texts, null as empty: a bucketed table, so that joins by key move no text again."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text"))).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # The grouping deals rows by key to this many partitions, each of which becomes one bucket as it is.
    return written(texts, "key", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt=True)


def remainders(docs: DataFrame, digest: bool, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, rest) of each distinct text; rest is the SHA-256 or the text that remains."""
    texts = distinct_texts(docs)
    spans = covered_spans(texts, length, gram, shard_bytes)
    joined = texts.select("key", "text").join(spans, "key", "left").select("key", "text", "spans")
    return joined.mapInArrow(partial(_rest, digest=digest), "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, rest string")


def removed_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that a `length`-byte string covers which also starts anywhere else goes, first places
    included. A null text is empty; texts shorter than `length` stay whole. Copies, and rows that
    repeat, count as places of their own. An empty table gives no rows. Only doc_id and text are read.
    """
    rest = remainders(docs, True, length)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("_key"))
    return keyed.join(rest, F.col("_key") == F.col("key")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("rest").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what remains of their texts, and n_chars to match; a code point that lost bytes goes whole.

    A null text stays null, an empty one empty. Copies and rows that repeat are places of their own, so all of them lose what
    they share. All other columns stay as they were, whatever their names. An empty table gives no rows.
    """
    own, key, kept, removed = unused(docs, "own", "key", "kept", "removed")
    rest = remainders(docs, False, length).select(F.col("key").alias(key), F.col("rest").alias(kept), F.col("n_removed").alias(removed))
    marked = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    whole = F.col("text").isNull() | (F.col(removed) == 0)
    changed = {"text": F.when(whole, F.col("text")).otherwise(F.col(kept))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return marked.join(rest, F.col(own) == F.col(key)).select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
