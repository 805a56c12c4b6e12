"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text's k-mers are its five-word shingles, labelled with their occurrence number. For each of
`HASHES` hash functions, the `KEPT` labelled k-mers with the least values are kept in the order that
they have in the text; their joint hash is one element of the sketch. Besides, a text's sketch has single
k-mers of `SINGLE_WORDS` words: all of them for texts of up to about `SINGLES` words, else those with the least hash
(an element of one kept k-mer). Texts of fewer than 20 words have all three-word k-mers too, and those of
at most 5 all two-word ones: with an edit for five words at most, some such k-mer of the longer text is left whole,
so that short texts always meet. Texts that share an element
meet in a bucket; a bucket of n texts pairs its members with one leader, which makes n - 1 pairs, and
members that the leader did not take meet again under another, in `TURNS` turns. Leaders are drawn
anew for each bucket and turn, so that most near texts soon are of one class. What is left of a bucket is
compared whole, however many texts it has: all pairs of its members that are of different classes by then. Lengths and counts of
words and of runs of two by hash leave few of these pairs possible; only those are rows, and only theirs are the texts that are moved. Pairs are verified by the edit distance over words in a band around the diagonal,
where the words that they don't share leave that possible. Classes are the connected components.
Equal texts are one text throughout, so copies never meet.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, _power_tables, checkpointed, discarded, mixed, pieces, ranges, span_hashes, spans_of, unused, utf8, word_spans, written

SHINGLE_WORDS, HASHES, KEPT, TURNS = 5, 24, 2, 2
#: Words of the k-mers that are elements by themselves, and how many a text has.
SINGLE_WORDS, SINGLES = 4, 32
#: Least edit similarity over words, 1 - distance / words of the longer text, of two near duplicates.
SIMILARITY = 0.8
#: Bins that a text's words, and its runs of two, are counted in; members of a bucket that is compared with its neighbours, and members compared in one group.
BINS, FEW, BLOCK = 256, 64, 4096
_SEEDS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled_kmers(ids: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-mers with their occurrence numbers, and where each text's begin.

    A text of fewer than `words` words is one k-mer; a text without words has none.
    """
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.repeat(first[:-1], counts) + ranges(counts)
    last = first[1:][doc]
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < last
        out = out * np.uint64(0x100000001B3) + np.where(there, ids[np.minimum(at + k, max(len(ids) - 1, 0))], np.uint64(k)) if len(ids) else out
    key = mixed(out) ^ mixed(doc.astype(np.uint64) + np.uint64(7))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.arange(len(key))
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0)) if len(key) else 0
    return mixed(out + occurrence * np.uint64(0xD1B54A32D192ED03)), begin


def sketches(kmers: np.ndarray, begin: np.ndarray, hashes: int, kept: int) -> np.ndarray:
    """The Order MinHash of each text: an int64 row; texts without k-mers get zeros."""
    out = np.zeros((len(begin) - 1, hashes), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out.view(np.int64)
    counts = np.diff(begin)[full]
    place = ranges(counts).astype(np.uint64)
    low = np.uint64((1 << 24) - 1)
    starts = begin[:-1][full]
    for j in range(hashes):
        h = (kmers ^ _SEEDS[j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h = (h & ~low) | np.minimum(place, low)
        least = []
        for turn in range(kept):
            m = np.minimum.reduceat(h, starts)
            least.append(m)
            if turn + 1 < kept:
                h = np.where(h == np.repeat(m, counts), np.uint64(2**64 - 1), h)
        value = np.stack([x & low for x in least])
        order = np.argsort(value, axis=0, kind="stable")
        tops = np.take_along_axis(np.stack(least) & ~low, order, axis=0)
        joint = np.full(len(full), np.uint64(j + 1))
        for x in tops:
            joint = mixed(joint * np.uint64(0x100000001B3) + x)
        out[full, j] = joint
    return out.view(np.int64)


def shingle_values(ids: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `words` words (a shorter text is one run), and where each text's begin."""
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = spans_of(first[:-1], counts)
    last = np.repeat(first[1:], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        out = out * np.uint64(0x100000001B3) + np.where(at + k < last, ids[np.minimum(at + k, max(len(ids) - 1, 0))], np.uint64(k)) if len(ids) else out
    return mixed(out + np.uint64(words)), np.concatenate(([0], np.cumsum(counts)))


def single_kmers(ids: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-mers that are elements by themselves, and where each text's begin."""
    n = np.diff(first)
    docs, values = [], []
    for words, there in ((SINGLE_WORDS, n > 0), (3, (n > 0) & (n < 20)), (2, (n > 0) & (n <= 5))):
        if not there.any():
            continue
        h, begin = shingle_values(ids, first, words)
        size = np.diff(begin)
        doc = np.repeat(np.arange(len(n)), size)
        # The least of a long text lie below a bound that leaves some four times as many; texts that it leaves too few stay whole.
        bound = np.minimum(4.0 * most / np.maximum(size, 1), 1.0) * 2.0**64
        low = there[doc] & (h.astype(np.float64) < bound[doc])
        short = (np.bincount(doc[low], minlength=len(n)) < 2 * most) & (bound < 2.0**64) & there
        if short.any():
            low |= short[doc]
        h, doc = h[low], doc[low]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        docs.append(doc[place < most])
        values.append(h[place < most])
    doc = np.concatenate([*docs, np.zeros(0, np.int64)])
    turn = np.argsort(doc, kind="stable")
    return np.concatenate([*values, np.zeros(0, np.uint64)])[turn].view(np.int64), np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))


SKETCHED = "node binary, n_words int, keys array<bigint>, bag binary"


def _sketch(batches, words: int, hashes: int, kept: int, singles: int):
    for part in pieces(batches, "text", 1 << 19):
        raw, at = utf8(part.column(1))
        begin, end, first = word_spans(raw, at)
        ids = span_hashes(raw, begin, end)
        rows = sketches(*labelled_kmers(ids, first, words), hashes, kept)
        single, cut = single_kmers(ids, first, singles)
        sizes = np.diff(cut) + hashes
        begin = np.concatenate(([0], np.cumsum(sizes)))
        # A text's joint elements come first, then its single k-mers.
        keys = np.empty(begin[-1], np.int64)
        joint = spans_of(begin[:-1], np.full(len(rows), hashes))
        keys[joint] = rows.reshape(-1)
        keys[np.setdiff1d(np.arange(len(keys)), joint, assume_unique=True)] = single
        lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys))
        # A text's words by bins, then its runs of two.
        bags = np.zeros((len(rows), 2, BINS), np.int64)
        for side, (h, cut) in enumerate(((ids, first), shingle_values(ids, first, 2))):
            bags[:, side] = np.bincount(np.repeat(np.arange(len(rows)), np.diff(cut)) * BINS + (h >> np.uint64(56)).astype(np.int64), minlength=len(rows) * BINS).reshape(-1, BINS)
        bags = np.minimum(bags, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first).astype(np.int32)), lists, pa.array([x.tobytes() for x in bags], pa.binary())], names=["node", "n_words", "keys", "bag"])


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of sequences, or most + 1 if it is more than `most`.

    All pairs of a call advance together, in a band around the diagonal that widens fourfold for those
    whose distance does not fit.
    """
    out = np.asarray(most, np.int64) + 1
    apart = np.array([abs(len(x) - len(y)) for x, y in zip(a, b)], np.int64)
    left, band = np.flatnonzero(apart <= most), 8
    while len(left):
        band *= 4
        left = left[np.argsort(most[left], kind="stable")]
        size = max(1, (1 << 19) // (2 * band + 1))
        again = []
        for i in range(0, len(left), size):
            part = left[i : i + size]
            found = _banded([a[k] for k in part], [b[k] for k in part], np.minimum(most[part], band))
            inside = found >= 0
            out[part[inside]] = found[inside]
            again.append(part[~inside & (most[part] > band)])
        left = np.concatenate(again)
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Distances of the pairs, at most `most`, else -1: for each number of edits and each diagonal of the band, the
    farthest place that so many edits reach. Runs of equal words are passed by hashes of 2**k words."""
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    x_at, y_at = np.cumsum(n) - n, np.cumsum(m) - m
    x, y = np.concatenate([*a, np.zeros(1, np.uint64)]), np.concatenate([*b, np.ones(1, np.uint64)])
    up, down = _power_tables(max(len(x), len(y)) + 1)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(z) * up[: len(z)]))) for z in (x, y)]
    longest = max(int(min(n.max(), m.max())).bit_length(), 1)

    def extend(now: np.ndarray, diagonal: np.ndarray) -> None:
        i, j = np.maximum(now, 0) + x_at[live][:, None], np.maximum(now + diagonal, 0) + y_at[live][:, None]
        row, column = np.nonzero(x[i] == y[j])
        far = now[row, column]
        room = np.minimum(n[live[row]] - far, m[live[row]] - far - diagonal[column])
        whole = (room > 0) & (far >= 0)
        row, column, room = row[whole], column[whole], room[whole]
        i, j, step = i[row, column], j[row, column], np.zeros(len(row), np.int64)
        for k in range(longest, -1, -1):
            p, q, size = i + step, j + step, 1 << k
            fits = np.flatnonzero(room - step >= size)
            p, q = p[fits], q[fits]
            same = (sums[0][p + size] - sums[0][p]) * down[p] == (sums[1][q + size] - sums[1][q]) * down[q]
            step[fits[same]] += size
        now[row, column] += step

    out, band = np.full(len(n), -1, np.int64), int(most.max(initial=0))
    live, goal = np.arange(len(n)), m - n
    none = np.int64(-(1 << 40))
    reach = np.full((len(n), 2 * band + 3), none)
    for e in range(band + 1):
        # A path on another diagonal ends too late if the edits that are left don't lead back.
        w = min(e, int((most[live] - e + np.abs(goal[live])).max()))
        inner = slice(band + 1 - w, band + 2 + w)
        if e == 0:
            now = np.zeros((len(live), 1), np.int64)
        else:
            now = np.maximum(reach[:, inner] + 1, reach[:, band - w : band + 1 + w])
            np.maximum(now, reach[:, band + 2 - w : band + 3 + w] + 1, out=now)
        diagonal = np.arange(-w, w + 1)
        np.minimum(now, np.minimum(n[live][:, None], m[live][:, None] - diagonal), out=now)
        now[(now < 0) | (now + diagonal < 0)] = none
        extend(now, diagonal)
        reach[:, inner] = now
        ended = (np.abs(goal[live]) <= w) & (now[np.arange(len(live)), np.clip(goal[live] + w, 0, 2 * w)] >= n[live])
        out[live[ended]] = e
        stay = ~ended & (most[live] > e)
        if not stay.all():
            live, reach = live[stay], reach[stay]
            if not len(live):
                break
    return out


def shared_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Words that both sequences of each pair have, repeats counted."""
    sides = []
    for side in (a, b):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        key = np.concatenate([*side, np.zeros(0, np.uint64)]) ^ mixed(owner.astype(np.uint64) + np.uint64(11))
        keys, place, counts = np.unique(key, return_index=True, return_counts=True)
        sides.append((keys, owner[place], counts))
    (keys, owner, counts), (others, _, more) = sides
    if not len(keys) or not len(others):
        return np.zeros(len(a), np.int64)
    at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
    return np.bincount(owner, np.where(others[at] == keys, np.minimum(counts, more[at]), 0), len(a)).astype(np.int64)


def _verify(batches, similarity: float):
    for part in pieces(batches, "a_text", 1 << 20):
        sides, runs = [], []
        for name in ("a_text", "b_text"):
            raw, at = utf8(part.column(part.schema.get_field_index(name)))
            begin, end, first = word_spans(raw, at)
            ids = span_hashes(raw, begin, end)
            sides.append([ids[i:j] for i, j in zip(first[:-1], first[1:])])
            two, first = shingle_values(ids, first, 2)
            runs.append([two[i:j] for i, j in zip(first[:-1], first[1:])])
        longer = np.array([max(len(x), len(y)) for x, y in zip(*sides)])
        most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
        # A word of the longer text that the other lacks costs an edit at least.
        maybe = np.flatnonzero(longer - shared_words(*sides) <= most)
        # An edit breaks two runs of two words at most, and the longer text has one less than words.
        maybe = maybe[longer[maybe] - 1 - shared_words(*([run[k] for k in maybe] for run in runs)) <= 2 * most[maybe]]
        near = np.zeros(len(longer), bool)
        near[maybe] = edit_distances(*([side[k] for k in maybe] for side in sides), most[maybe]) <= most[maybe]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near))


def _bags(column) -> tuple[np.ndarray, np.ndarray]:
    """The counts of words by bins, and of runs of two words; a row for each text."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2, BINS)
    return both[:, 0], both[:, 1]


def _possible(key, group: pa.Table, similarity: float) -> pa.Table:
    """Pairs of different classes whose lengths and bags leave the similarity possible."""
    n = group.column("n_words").to_numpy()
    order = np.argsort(n, kind="stable")
    n = n[order].astype(np.int64)
    nodes, of = group.column("node").combine_chunks(), group.column("c").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    cell, size = group.column("cell").to_numpy()[order], group.column("length").to_numpy()[order]
    bags, runs = _bags(group.column("bag"))
    bags, runs = bags[order], runs[order]
    coarse = bags.reshape(len(bags), 16, -1).sum(axis=2, dtype=np.int16)
    _, g, low, high = (x.as_py() for x in key)
    most = np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    # n - most never falls with n, so the texts that are short enough for a longer one come in a row.
    upto = np.searchsorted(n - most, n, "right")
    left, right = [], []
    for i in range(len(n)):
        j = slice(i + 1, int(upto[i]))
        may = (of[j] != of[i]) & ((size[j] == g) | (size[i] == g))
        if low != high:
            may &= cell[j] != cell[i]
        at = i + 1 + np.flatnonzero(may)
        # Words of the longer text that the other lacks, by bins: in few bins first. An edit breaks two runs of two words at most.
        for bins, edits in ((coarse, 1), (bags, 1), (runs, 2)):
            if len(at):
                at = at[np.where(bins[at] > bins[i], bins[at] - bins[i], 0).sum(axis=1, dtype=np.int64) <= edits * most[at]]
        if len(at):
            left.append(np.full(len(at), i))
            right.append(at)
    take = lambda x: nodes.take(pa.array(order[np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)]))
    return pa.table({"a": take(left), "b": take(right)})


def _near_in_buckets(batches, similarity: float):
    """The possible pairs (a, b) of buckets of a few members; rows (key, node, n_words, c, bag) come sorted by key."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, n = rows.column(0).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
        nodes, of = rows.column(1).combine_chunks(), rows.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
        bags = _bags(rows.column(4))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, len(key)):
            i = np.flatnonzero(key[apart:] == key[:-apart])
            if not len(i):
                break
            j = i + apart
            longer, most = np.maximum(n[i], n[j]), np.floor((1 - similarity) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64)
            may = (of[i] != of[j]) & (longer - np.minimum(n[i], n[j]) <= most)
            i, j, most = i[may], j[may], most[may]
            i, j = np.where(n[i] >= n[j], i, j), np.where(n[i] >= n[j], j, i)
            for bins, edits in zip(bags, (1, 2)):
                may = (bins[i] - np.minimum(bins[i], bins[j])).sum(axis=1, dtype=np.int64) <= edits * most
                i, j, most = i[may], j[may], most[may]
            left.append(i), right.append(j)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["a", "b"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        # The last bucket may go on in the next batch.
        whole = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
        held = rows.slice(whole)
        if whole:
            yield pairs(rows.slice(0, whole))
    if held is not None:
        yield pairs(held)


def _run_counts(batches):
    """(node, fine): how often a text's runs of two words fall in each of as many bins as it has words or more, two bits each (3: or more)."""
    for part in pieces(batches, "text", 1 << 20):
        raw, at = utf8(part.column(1))
        begin, end, first = word_spans(raw, at)
        h, cut = shingle_values(span_hashes(raw, begin, end), first, 2)
        bits = np.ceil(np.log2(np.maximum(np.diff(first), BINS))).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(1 << bits)))
        doc = np.repeat(np.arange(len(bits)), np.diff(cut))
        counts = np.bincount(base[doc] + (h >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64), minlength=base[-1])
        four = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
        packed = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
        fine = pa.array([packed[i:j] for i, j in zip((base[:-1] // 4).tolist(), (base[1:] // 4).tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), fine], names=["node", "fine"])


_FOUR = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)


def _near_by_runs(batches, similarity: float):
    """The pairs (a, b, words of each, fine counts of each) whose runs of two words leave the similarity possible."""
    for part in batches:
        near = []
        for n, m, x, y in zip(*(part.column(k).to_pylist() for k in range(2, 6))):
            (long, more), (short, _) = sorted(((x, n), (y, m)), key=lambda z: -z[1])
            sides = [_FOUR[np.frombuffer(z, np.uint8)].reshape(-1) for z in (long, short)]
            size = min(len(z) for z in sides)
            # The finer counts are added up; sums of what was cut at 3, cut at 3 again, are those of the whole counts.
            long, short = (np.minimum(z.reshape(size, -1).sum(axis=1, dtype=np.int64), 3) for z in sides)
            near.append(int((long - np.minimum(long, short)).sum()) <= 2 * math.floor((1 - similarity) * more + 1e-9))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def near_by_runs(pairs: DataFrame, known: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose texts have enough runs of two words in common, by counts much smaller than the texts."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct()
    fine = known.join(nodes, F.col("node") == F.col("m"), "left_semi").select("node", "text").mapInArrow(_run_counts, "node binary, fine binary")
    fine = written(fine.join(texts.select(F.col("node").alias("m"), "n_words"), F.col("node") == F.col("m")).select("node", "n_words", "fine"), "node", parts)
    for side in ("a", "b"):
        pairs = pairs.join(fine.select(F.col("node").alias(side), F.col("n_words").alias(f"{side}_words"), F.col("fine").alias(f"{side}_fine")), side)
    found = written(pairs.select("a", "b", "a_words", "b_words", "a_fine", "b_fine").mapInArrow(partial(_near_by_runs, similarity=similarity), "a binary, b binary"))
    discarded(fine)
    return found


def rest_pairs(members: DataFrame, classes: DataFrame, bags: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b), and the tables that it is made of: all pairs of a bucket's members that are of different classes, where their lengths leave the similarity possible.

    No bucket is cut. The largest buckets are dealt by length (a group has two neighbouring lengths' texts) and by blocks of members.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classed = members.join(classes.select(F.col("node").alias("m"), "root"), F.col("node") == F.col("m"), "left").select("key", "node", "n_words", "n", F.coalesce("root", "node").alias("c"))
    classed = written(classed, "key", parts)
    mixed_keys = classed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select(F.col("key").alias("k"))
    open_ = classed.join(mixed_keys, F.col("key") == F.col("k"))
    open_ = written(open_.select("key", "node", "n_words", "c", "n"))
    bagged = lambda rows, *columns: rows.join(bags.select(F.col("node").alias("m"), "bag"), F.col("node") == F.col("m")).select("key", *columns, "bag")
    # Small buckets are compared in place, so that no join makes their pairs.
    few = bagged(open_.filter(F.col("n") <= FEW), "node", "n_words", "c").repartition(parts, "key").sortWithinPartitions("key")
    pairs = few.mapInArrow(partial(_near_in_buckets, similarity=similarity), "a binary, b binary")
    step = max(-math.log(max(similarity, 1e-6)), 1e-6) * 1.0001
    # A bucket of up to `BLOCK` texts is one group; larger ones are dealt by length too.
    many = open_.filter(F.col("n") > FEW).withColumn("length", F.when(F.col("n") <= BLOCK, -1).otherwise(F.floor(F.log("n_words") / step)).cast("long"))
    many = many.withColumn("g", F.explode(F.when(F.col("length") < 0, F.array("length")).otherwise(F.array(F.col("length"), F.col("length") + 1))))
    counts = many.groupBy("key", "g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cells"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("inside")).filter((F.col("longest") == F.col("g")) & (F.col("inside") > 1)).select(F.col("key").alias("k"), F.col("g").alias("kg"), "cells")
    many = many.join(counts, (F.col("key") == F.col("k")) & (F.col("g") == F.col("kg"))).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    many = many.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).withColumns({"low": F.least("cell", "_o"), "high": F.greatest("cell", "_o")})
    many = bagged(many, "g", "low", "high", "node", "n_words", "c", "cell", "length")
    pairs = pairs.union(many.groupBy("key", "g", "low", "high").applyInArrow(lambda key, group: _possible(key, group, similarity), "a binary, b binary"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), [classed, open_]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b): the least node of each connected component.

    Large-star and small-star steps in turn; each takes the least neighbour by a partial
    aggregation, and a round's edges are written to the checkpoint folder.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(down, F.col("b") == F.col("u")).select(F.least("a", "m").alias("x"), F.greatest("a", "m").alias("y"), "u", "m")
        edges = small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a != b").distinct()
        edges = checkpointed(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, hashes: int = HASHES, kept: int = KEPT, similarity: float = SIMILARITY, turns: int = TURNS, singles: int = SINGLES) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links (other texts that
    its text was linked to, copies not counted), copies (documents with the same text), n_words, node and root (hashes of
    the text and of one text of its class: classes of different root are different even if doc_ids repeat).

    A null text, or one without words, is a class of its own for each document. Repeated rows are
    copies. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worded = F.when(F.col("text").rlike(WORD), F.unhex(F.md5("text")))
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("node", worded)
    # The distinct texts are moved once, into buckets by node: joins by it don't move them again.
    known = slim.filter("node is not null").groupBy("node").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    known = written(known, "node", parts, dealt=True)
    texts = written(known.select("node", "text").mapInArrow(partial(_sketch, words=words, hashes=hashes, kept=kept, singles=singles), SKETCHED), "node", parts)
    each = texts.select("node", "n_words", F.posexplode("keys").alias("band", "value"))
    band = F.least(F.col("band"), F.lit(hashes))
    members = each.select("node", "n_words", F.xxhash64(band, "value").alias("key"), (band == hashes).alias("single")).repartition("key")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"), "n")
    members = written(members.join(shared, F.col("key") == F.col("k")).select("node", "n_words", "key", "single", "n"))
    # Only the joint elements have leaders: those of single k-mers have many members that are not alike.
    every_member, members = members, members.filter("not single").select("node", "n_words", "key")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(known.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")
        return checkpointed(sides.mapInArrow(partial(_verify, similarity=similarity), "a binary, b binary"))

    links: list[DataFrame] = []
    met_again: list[DataFrame] = []
    for turn in range(turns):
        leaders = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("p"), "node", "n_words")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"), F.col("l.node").alias("leader"), F.col("l.n_words").alias("l_words"))
        met = members.join(leaders, F.col("key") == F.col("k")).filter("node != leader")
        most = F.greatest("n_words", "l_words")
        found = verified(met.filter(most - F.least("n_words", "l_words") <= F.floor((1 - similarity) * most + 1e-9)).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
        links.append(found)
        # Those that neither lead nor were taken by their leader meet again.
        taken = found.select("a", "b").union(found.select("b", "a")).toDF("leader", "node")
        if turn + 1 < turns:
            members = written(met.join(taken, ["leader", "node"], "left_anti").select("node", "n_words", "key"))
            met_again.append(members)
    # Members of different classes that no leader joined are compared with each other.
    led = reduce(DataFrame.union, links).distinct() if links else known.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    classes = components(led)
    pairs, tables = rest_pairs(every_member, classes, texts.select("node", "n_words", "bag"), similarity)
    possible = written(pairs)
    discarded(every_member, *tables, *met_again)
    near = near_by_runs(possible, known, texts, similarity)
    more = verified(near)
    n_words = checkpointed(texts.select("node", "n_words"))
    discarded(texts, possible, near)
    links.append(more)
    every = reduce(DataFrame.union, links).distinct()
    classes = components(classes.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
    degree = every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    copies = known.select("node", "copies", "least").join(n_words, "node").join(classes, "node", "left").join(degree, "node", "left")
    copies = checkpointed(copies.withColumn("root", F.coalesce("root", "node")))
    discarded(known)
    classes = copies.groupBy("root").agg(F.min("least").alias("class_id"))
    named = copies.join(classes, "root").select(F.col("node").alias("_node"), "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies", "n_words")
    return slim.select("doc_id", "node").join(named, F.col("node") == F.col("_node"), "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"),
        F.lower(F.hex("node")).alias("node"), F.lower(F.hex("root")).alias("root"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with the least doc_id of each class, all their columns as they were.

    A null doc_id comes after all others. Of rows that repeat both doc_id and text one stays; texts
    without words all stay.
    """
    found = near_duplicates(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f")
    stay = checkpointed(found.filter("node is not null").groupBy("root").agg(first).select("f.doc_id", "f.node"))
    columns = docs.columns
    own, pair, id_, node, other = unused(docs, "own", "pair", "id", "node", "other")
    worded = F.when(F.col("text").rlike(WORD), F.unhex(F.md5("text")))
    marked = docs.withColumn(own, worded).withColumn(pair, F.xxhash64(own, "doc_id"))
    s = stay.select(F.col("doc_id").alias(id_), F.unhex("node").alias(node)).withColumn(other, F.xxhash64(node, id_))
    # The texts are moved once: joined by text and doc_id, so that copies are dealt apart, and rows that repeat are next to each other.
    found = marked.filter(F.col(own).isNotNull()).join(s, (F.col(pair) == F.col(other)) & (F.col(own) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    return found.dropDuplicates([pair, own]).select(*columns).union(marked.filter(F.col(own).isNull()).select(*columns))
