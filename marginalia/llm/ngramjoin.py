"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 3-word shingles, ordered from the rarest in the corpus to the most frequent. Two sets whose
Jaccard similarity is t at least share l shingles or more in their prefixes of |s| - ceil(t |s|) + l, for any l. Each document
takes the l from 1 to `MOST` whose estimated cost is least: a longer prefix meets more documents, but more of its shingles have to
be shared before the texts are compared, the less of the two documents' l at least. Shingles that only one text has can't be
shared, so a document with as many of them as its prefix is long meets nobody. Of two documents that meet, the sizes tell how many
shingles they have to share at least, hence a prefix of this pair's own, mostly half as long, in which their matches count.

How many texts have a shingle is counted by a 32-bit print in one of many buckets: blocks of texts send each print once, and get
back those that others have too. Prints that meet by chance alter the order only, which is the same for all documents. Of the
documents that meet, the members of each shared shingle first try a few leaders, in turns; then those of different components are
compared, so that a group of many near copies costs links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, discarded, lower_ascii, mixed, pieces, span_hashes, spans_of, utf8, word_spans, written
from .neardup import components

#: Words of a shingle; percent of the union that is shared at least.
WORDS, PERCENT = 3, 90
#: Most matches that a prefix asks for; the cost of comparing two texts, in postings (few that meet once don't share their pair's prefix).
MOST, VERIFY = 4, 1
#: Bytes of text in a slice, whose prints are counted together, and for each bucket of prints.
SLICE, BUCKET = 8 << 20, 16 << 20
#: Turns in which members meet leaders, and leaders of a list; members of a list, and pairs of one text, that meet in one task.
TURNS, LEADERS, DEAL, PAIRS = 2, 4, 256, 1024


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the distinct shingles of each row of lower-cased bytes, by row and value. A row of fewer words has one, its whole sequence."""
    begin, end, first = word_spans(raw, at)
    n = np.diff(first)
    counts = np.where(n >= words, n - words + 1, n > 0)
    row, place = np.repeat(np.arange(len(n)), counts), spans_of(first[:-1], counts)
    if not len(place):
        return row, np.zeros(0, np.uint64)
    ids = np.concatenate([span_hashes(raw, begin, end), np.zeros(words, np.uint64)])
    value = np.zeros(len(place), np.uint64)
    for k in range(words):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + np.where(k < n[row], ids[place + k], np.uint64(k + 1)))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    return row[fresh], value[fresh]


def _texts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a slice's rows with their shingle sets."""
    for part in pieces(table.to_batches(), "text"):
        raw, at = utf8(part.column(part.schema.get_field_index("text")))
        yield (part, *shingle_sets(lower_ascii(raw), at))


def _print_keys(value: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and print of each shingle in one number."""
    return ((value >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))


PRINTS = "slice bigint, bucket bigint, prints binary, counts binary"


def _cut(slices, keys: np.ndarray, numbers: np.ndarray) -> pa.Table:
    """Sorted keys of a slice as rows of PRINTS, one for each bucket."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys))
    low, numbers = keys.astype(np.uint32), numbers.astype(np.uint32)
    blobs = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (low, numbers)]
    return pa.table([pa.array(np.full(len(starts), slices)), pa.array(bucket[starts]), *blobs], names=["slice", "bucket", "prints", "counts"])


def _prints(table: pa.Table, buckets: int) -> pa.Table:
    """The prints of a slice's shingles, each with the number of its texts that have it."""
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_print_keys(value, buckets) for _, _, value in _texts(table))]), return_counts=True)
    return _cut(table.column("slice")[0].as_py(), keys, counts)


def _shared(table: pa.Table) -> pa.Table:
    """The prints of a bucket that several texts have, back to the slices, with the number of those texts."""
    read = lambda name: [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(name)]
    prints = read("prints")
    _, place = np.unique(np.concatenate(prints), return_inverse=True)
    df = np.bincount(place, weights=np.concatenate(read("counts")))[place]
    at = np.cumsum([0, *map(len, prints)])
    out = []
    for k, (own, low) in enumerate(zip(table.column("slice").to_pylist(), prints, strict=True)):
        n = df[at[k] : at[k + 1]]
        if (n > 1).any():
            keys = low[n > 1].astype(np.uint64) | np.uint64(table.column("bucket")[k].as_py() << 32)
            out.append(_cut(own, keys, np.minimum(n[n > 1], 2**32 - 1)))
    return pa.concat_tables(out) if out else table.slice(0, 0).select(["slice", "bucket", "prints", "counts"])


CHOSEN = "node binary, n int, need int, keys array<bigint>, places array<int>"


def prefixes(row: np.ndarray, value: np.ndarray, df: np.ndarray, n_rows: int, percent: int, most: int, cost: float) -> tuple[np.ndarray, ...]:
    """Set size and matches asked for of each row, and the rows, shingles and places in the row's order of the prefixes, without shingles of one text."""
    order = np.lexsort((value, df, row))
    row, value, df = row[order], value[order], df[order]
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    free = n - (percent * n + 99) // 100
    met = np.concatenate([[0], np.cumsum(df - 1)])
    best, need = np.full(n_rows, np.inf), np.ones(n_rows, np.int64)
    for l in range(1, most + 1):  # noqa: E741
        can = free + l <= n
        end = first + np.minimum(free + l, n)
        candidates = met[end] - met[first]  # postings met; at most so many / l documents share l
        now = np.where(can, candidates * (1 + cost / l), np.inf)
        need = np.where(now < best, l, need)
        best = np.minimum(best, now)
    held = (place < (free + need)[row]) & (df > 1)
    return n, need, row[held], value[held], place[held]


def _choose(left: pa.Table, right: pa.Table, buckets: int, percent: int, most: int, cost: float) -> pa.Table:
    """Each text of a slice with its size and its prefix."""
    none = np.zeros(0, np.uint64)
    blobs = lambda name: np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in right.column(name))])
    high = np.repeat(np.array(right.column("bucket").to_pylist(), np.uint64), [len(x.as_buffer()) // 4 for x in right.column("prints")]) if len(right) else none
    keys = (high << np.uint64(32)) | blobs("prints").astype(np.uint64)
    order = np.argsort(keys)
    keys, counts = keys[order], blobs("counts").astype(np.int64)[order]
    out = []
    for part, row, value in _texts(left):
        df = np.ones(len(value), np.int64)
        if len(keys):
            wanted = _print_keys(value, buckets)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            df = np.where(keys[at] == wanted, counts[at], 1)
        n, need, held, shingle, place = prefixes(row, value, df, part.num_rows, percent, most, cost)
        at = np.searchsorted(held, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (shingle.view(np.int64), place.astype(np.int32))]
        out.append(pa.table([part.column(part.schema.get_field_index("node")), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32)), *lists], names=[x.split()[0] for x in CHOSEN.split(", ")]))
    return pa.concat_tables(out)


def _unrepeated(batches) -> Iterator[pa.RecordBatch]:
    """Without rows whose node came before in the partition, so that copies are not moved."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for node in b.column(0).to_pylist():
            keep.append(node not in seen)
            seen.add(node)
        yield b.filter(pa.array(keep, pa.bool_()))


def _alike(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, a_text, b_text) whose sets share `percent` of their union at least."""
    for whole in batches:
        for b in pieces((p for p in pieces([whole], "a_text", 2 << 20)), "b_text", 2 << 20):
            sets = []
            for name in ("a_text", "b_text"):
                raw, at = utf8(b.column(b.schema.get_field_index(name)))
                sets.append(shingle_sets(lower_ascii(raw), at))
            row, value = (np.concatenate(x) for x in zip(*sets, strict=True))
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
            shared = np.bincount(row[1:][twice], minlength=b.num_rows)
            union = np.bincount(row, minlength=b.num_rows) - shared
            links = b.filter(pa.array(100 * shared >= percent * union))
            yield pa.RecordBatch.from_arrays([links.column(links.schema.get_field_index(x)) for x in "ab"], names=["a", "b"])


def _compared(pairs: DataFrame, known: DataFrame, slice_of, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked. Texts are found in their slices without moving the others; a text of many
    pairs is sent out once for each `PAIRS` of them."""
    text = known.select("slice", F.col("node").alias("k"), "text")
    many = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("bigint").alias("c")))
    turns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("turn")
    a = many.withColumn("s", slice_of(F.col("a"))).join(text, (F.col("s") == F.col("slice")) & (F.col("a") == F.col("k"))).select("a", turns, F.col("text").alias("a_text"))
    b = pairs.join(many, "a").withColumns({"s": slice_of(F.col("b")), "turn": F.pmod(F.xxhash64("b"), F.col("c"))})
    b = b.join(text, (F.col("s") == F.col("slice")) & (F.col("b") == F.col("k"))).select("a", "turn", "b", F.col("text").alias("b_text"))
    return checkpointed(b.join(a, ["a", "turn"]).select("a", "b", "a_text", "b_text").mapInArrow(partial(_alike, percent=percent), "a binary, b binary"))


def _may_match(a: Column, b: Column, percent: int) -> Column:
    """Whether two postings of a shingle (n, need, place) count for their documents: the sizes allow a link, and both places are in
    the prefixes that the pair's least overlap and the less of their needs leave."""
    n, m = a["n"].cast("bigint"), b["n"].cast("bigint")
    spare = F.least(a["need"], b["need"]) - F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (a["place"] < n + spare) & (b["place"] < m + spare)


def _by_list(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members (key, node, own, root) of the lists that hold several components, each with `main`, the root of its list's largest one, and the list's deals."""
    rooted = written(members.join(classes.select(F.col("node").alias("v"), "root"), F.col("node") == F.col("v"), "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "own", "root"))
    main = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("roots"))
    main = main.filter("roots > 1").select(F.col("key").alias("l"), F.col("x.root").alias("main"), F.ceil(F.col("all") / DEAL).cast("bigint").alias("deals"))
    lists = written(rooted.join(main, F.col("key") == F.col("l")).drop("l"))
    discarded(rooted)
    return lists


def _led(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a list's leaders and its members of other components.

    In the first turn those lead that have the fewest rarer shingles, as most of a group is alike to them; later some of the main component.
    """
    first = [F.col("own.place")] if turn == 0 else []
    order = Window.partitionBy("key").orderBy(*first, F.xxhash64("node", F.lit(turn)), "node")
    leading = (lists if turn == 0 else lists.filter("root = main")).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= LEADERS)
    leading = leading.select(F.col("key").alias("k"), F.col("node").alias("leader"), F.col("own").alias("own_l"), F.col("root").alias("root_l"))
    met = lists.join(leading, (F.col("key") == F.col("k")) & (F.col("root") != F.col("root_l")) & _may_match(F.col("own"), F.col("own_l"), percent))
    return checkpointed(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())


def _apart(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share as many shingles of their prefixes as the less asks for.

    In each list the members outside its main component meet all members; a long list's members are dealt out.
    """
    turns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal")
    a = lists.filter("root <> main").select("key", turns, F.col("node").alias("a"), F.col("own").alias("own_a"), F.col("root").alias("root_a"))
    b = lists.select("key", F.pmod(F.xxhash64("node"), F.col("deals")).alias("deal"), F.col("node").alias("b"), "own", "root", "main")
    met = a.join(b, ["key", "deal"]).filter((F.col("root_a") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("b"))) & _may_match(F.col("own_a"), F.col("own"), percent))
    # A list's main component may be another one's small one: both directions count as one pair.
    pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("own_a.need", "own.need").alias("need"))
    return checkpointed(pair.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("m")).filter("m >= need").select("a", "b"))


def joined(docs: DataFrame, percent: int = PERCENT, most: int = MOST, cost: float = VERIFY, turns: int = TURNS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    A null or empty text, or one without words, has 0 shingles and is a component of its own. A text of fewer than three words has
    one shingle, the whole sequence. Copies, and rows that repeat, are linked. A null doc_id is no least one: its row has the
    component's least other doc_id, or null. An empty table gives no rows. Columns other than doc_id and text aren't read, whatever
    their names. Texts are read whole; one longer than a slice (8 MB) is a piece of its own. Shingles are told apart by 64-bit hashes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("node", F.when(F.col("text").rlike(WORD), F.unhex(F.md5("text"))))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, buckets = max(parts, -(-size // SLICE)), max(2 * parts, -(-size // BUCKET))
    slice_of = lambda node: F.pmod(F.xxhash64(node), F.lit(slices))
    # The distinct texts are moved once, into buckets of whole slices: what is done by slice doesn't move them again.
    each = slim.filter("node is not null").select("node", "text").mapInArrow(_unrepeated, "node binary, text string").withColumn("slice", slice_of(F.col("node")))
    known = written(each.repartition(parts, "slice").groupBy("slice", "node").agg(F.first("text").alias("text")), "slice", parts, dealt=True)

    def prints(own: pa.Table) -> pa.Table:
        return _prints(own, buckets)

    def choose(own: pa.Table, held: pa.Table) -> pa.Table:
        return _choose(own, held, buckets, percent, most, cost)

    shared = known.groupBy("slice").applyInArrow(prints, PRINTS).groupBy("bucket").applyInArrow(_shared, PRINTS)
    chosen = written(known.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(choose, CHOSEN))
    lists = chosen.select("node", "n", "need", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("node", F.struct("n", "need", F.col("x.places").alias("place")).alias("own"), F.col("x.keys").alias("key"))
    several = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("key").alias("k"))
    members = written(lists.join(several, F.col("key") == F.col("k")).drop("k"))
    classes = members.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(turns + 1):
        lists = _by_list(members, classes)
        pairs = _led(lists, turn, percent) if turn < turns else _apart(lists, percent)
        links = _compared(pairs, known, slice_of, percent)
        classes = components(classes.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links))
        discarded(lists)
    sized = checkpointed(chosen.select("node", "n").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discarded(known, chosen, members)
    own = slim.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = sized.join(own, "node")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = sized.join(least, "root").select(F.col("node").alias("k"), "n", "component_id")
    found = slim.select("doc_id", "node").join(named, F.col("node") == F.col("k"), "left")
    return found.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT row, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.row AS a, y.row AS b, count(*) AS m FROM s x JOIN s y USING (shingle) WHERE x.row <> y.row GROUP BY ALL) p JOIN n na ON na.row = p.a JOIN n nb ON nb.row = p.b
  WHERE 100 * p.m >= {PERCENT} * (na.n + nb.n - p.m)),
reach AS (SELECT row, row AS other FROM d UNION SELECT r.row, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, o.component_id
FROM d LEFT JOIN n USING (row) JOIN (SELECT r.row, min(e.doc_id) AS component_id FROM reach r JOIN d e ON e.row = r.other GROUP BY r.row) o USING (row)
"""
