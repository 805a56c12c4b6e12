"""Terms of texts as byte spans, and a stated set of terms to look for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import span_hashes, spans_of

#: Bytes of which terms are made: ASCII letters and all bytes of other characters; with ASCII digits too.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True


def term_spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are `inside`, and the first run's number for each row (one more than rows)."""
    held = np.zeros(len(raw) + 2, bool)
    held[1:-1] = inside[raw]
    begins = held[1:-1] & ~held[:-2]
    ends = held[1:-1] & ~held[2:]
    borders = at[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    begins[borders] = held[1:-1][borders]
    ends[borders - 1] = held[1:-1][borders - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    size = end - begin
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[spans_of(begin, size)]))])


class Asked:
    """A set of distinct terms, each with a code 0 .. n-1, that spans of texts are looked up in: by hash, then byte by byte."""

    def __init__(self, terms: list[str]):
        parts = [t.encode() for t in terms]
        size = np.array([len(p) for p in parts], np.int64)
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum(size) - size
        hashes = span_hashes(self.raw, begin, begin + size) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.code, self.begin, self.size = hashes[order], order.astype(np.int64), begin[order], size[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of one hash")

    def found(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the lower-cased spans are in the set, and their codes."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes) or not len(begin):
            return none, none
        h = span_hashes(raw, begin, end)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        which = np.flatnonzero((self.hashes[place] == h) & (self.size[place] == end - begin))
        if not len(which):
            return none, none
        place = place[which]
        size = self.size[place]
        same = raw[spans_of(begin[which], size)] == self.raw[spans_of(self.begin[place], size)]
        equal = np.logical_and.reduceat(same, np.cumsum(size) - size)
        return which[equal], self.code[place[equal]]


