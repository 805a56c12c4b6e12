"""Quality rules from a suffix array over words.

The suffixes of all documents of a slice are sorted together by prefix doubling on word ranks; a
suffix leaves the work as soon as no other of its document equals it so far, and ends with its
document. Neighbours in the order give the longest common prefixes, in words. An interval of
suffixes that share at least k words is a substring found twice or more; the union of the spans of
the maximal ones is what the rules limit.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mixed, pieces, span_hashes, utf8, word_spans

#: Words in a repeat that counts for the base rule, and for the suffix-array rules.
BASE_WORDS, REPEAT_WORDS = 5, 10
#: Most share of a text's words in repeats, and most words in one repeat that does not overlap itself.
MOST_COVERED, MOST_LONGEST = 0.3, 200
#: Fewest words, and most percent of words in repeated 5-word windows.
FEWEST_WORDS, MOST_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "covered_words bigint, longest_repeat bigint, kept boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def neighbours(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-array neighbours that share a word at least: the two starts and the words shared.

    ids: a number for each word, equal for equal words; first: each document's first word, one
    more than documents. Suffixes of different documents are never neighbours.
    """
    n = len(ids)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's document
    key = ids ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    live = np.argsort(key, kind="stable")
    place = np.arange(n)  # in the suffix array
    equal = np.zeros(n, bool)
    equal[1:] = key[live[1:]] == key[live[:-1]]
    rank = np.full(n + 1, -1, np.int64)  # of a group: the place of its first suffix
    rank[live] = np.maximum.accumulate(np.where(equal, 0, place))
    levels, found, step = [], [], 1
    while True:
        # Only suffixes that equal a neighbour so far go on.
        keep = equal.copy()
        keep[:-1] |= equal[1:]
        live, place = live[keep], place[keep]
        if not len(live):
            break
        levels.append(rank.copy())
        group, ahead = rank[live], live + step
        key = np.where(ahead < last[live], rank[np.minimum(ahead, n)], -1)
        turn = np.lexsort((key, group))
        live, group, key = live[turn], group[turn], key[turn]
        joined = np.zeros(len(live), bool)
        joined[1:] = group[1:] == group[:-1]
        equal = joined.copy()
        equal[1:] &= key[1:] == key[:-1]
        at = np.flatnonzero(joined & ~equal)
        found.append((live[at - 1], live[at], _common(levels, live[at - 1], live[at], n)))
        rank[live] = np.maximum.accumulate(np.where(equal, 0, place))
        step *= 2
    return tuple(np.concatenate(x) if x else none for x in (zip(*found) if found else ((), (), ())))


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Words that the suffixes at a and b share: from ranks by 1, 2, 4, ... words, the most first."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = levels[k][np.minimum(a + out, n)], levels[k][np.minimum(b + out, n)]
        out += ((x >= 0) & (x == y)) * (1 << k)
    return out


def repeats(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the longest run of words from it that is found elsewhere in its document."""
    a, b, shared = neighbours(ids, first)
    out = np.zeros(len(ids), np.int64)
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def covered(longest: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Words of each document in the union of its repeats of at least `least` words."""
    n = len(longest)
    reach = np.where(longest >= least, np.arange(n) + longest, 0)
    inside = np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)
    sums = np.concatenate(([0], np.cumsum(inside)))
    return sums[first[1:]] - sums[first[:-1]]


def window_words(longest: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Words of each document in windows of `words` words that are found twice or more."""
    n = len(longest)
    reach = np.where(longest >= words, np.arange(n) + words, 0)
    # A repeat of more words holds repeated windows from each of its starts.
    inside = np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)
    sums = np.concatenate(([0], np.cumsum(inside)))
    return sums[first[1:]] - sums[first[:-1]]


def duplicate_lines(raw: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, for each text."""
    if not len(raw):
        return np.zeros(len(at) - 1, np.int64)
    cut = np.flatnonzero(raw == 10)
    texts = np.flatnonzero(np.diff(at))
    begin = np.concatenate((at[texts], cut + 1))
    end = np.concatenate((at[texts + 1], cut))
    begin.sort(), end.sort()
    doc = np.searchsorted(at, begin, "right") - 1
    own = (begin < at[np.minimum(doc + 1, len(at) - 1)]) & (end > begin)
    begin, end, doc = begin[own], end[own], doc[own]
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    key = span_hashes(raw, begin, end) ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    _, place = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=len(at) - 1) - np.bincount(doc[place], minlength=len(at) - 1)


def measures(column, base_words: int = BASE_WORDS, repeat_words: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The figures of each text of an Arrow string column."""
    raw, at = utf8(column)
    begin, end, first = word_spans(raw, at)
    ids = span_hashes(raw, begin, end)
    longest = repeats(ids, first)
    tail = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(tail[end] - tail[begin])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[raw])))
    most = np.zeros(len(at) - 1, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    np.maximum.at(most, doc, longest)
    return {
        "n_words": np.diff(first), "word_chars": np.diff(chars[first]), "n_symbols": np.diff(symbols[at]), "n_dup_lines": duplicate_lines(raw, at, begin),
        "n_repeat_words": window_words(longest, first, base_words), "covered_words": covered(longest, first, repeat_words), "longest_repeat": most,
    }


def verdicts(x: dict[str, np.ndarray], most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> dict[str, np.ndarray]:
    failed = (x["n_words"] < FEWEST_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEAT_PERCENT * x["n_words"])
    kept = ~failed & (x["covered_words"] <= most_covered * x["n_words"]) & (x["longest_repeat"] <= most_longest)
    return x | {"base_failed": failed, "kept": kept}


def _rows(batches, most_covered: float, most_longest: int):
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
    for part in pieces(batches, "text"):
        out = verdicts(measures(part.column(1)), most_covered, most_longest)
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64())] + [pa.array(out[k]) for k in names[1:]], names=names)


def quality_rules(docs: DataFrame, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """One row per document: its base figures, what its repeats cover, and whether it is kept.

    A null or empty text has no words and fails. A null or repeated doc_id is carried through, a
    row for each. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return slim.mapInArrow(partial(_rows, most_covered=most_covered, most_longest=most_longest), SCHEMA)


def _keep(batches, most_covered: float, most_longest: int, column: str):
    for part in pieces(batches, column):
        out = verdicts(measures(part.column(part.schema.get_field_index(column))), most_covered, most_longest)
        yield part.filter(pa.array(out["kept"]))


def keep_good(docs: DataFrame, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """The documents that the rules keep, all their columns as they were."""
    return docs.mapInArrow(partial(_keep, most_covered=most_covered, most_longest=most_longest, column="text"), docs.schema)
