"""External induced sorting of suffixes, with their longest common prefixes.

Suffixes are sorted from the order of the leftmost S-type ones (LMS): one ascending scan induces the
L-type suffixes, one descending scan the S-type. Both scans are driven by a queue of tuples (symbol,
position, common prefix with the tuple before it in the symbol's bucket) that is ordered by symbol and
arrival, holds a bounded number of tuples in memory and the rest on disk. Every string is sorted so, however short. The common prefix of two
induced neighbours is one more than the least common prefix scanned between their sources. The LMS
order comes from the same algorithm applied to the string of LMS substring names, until that fits in
memory; names beyond the queue's symbol range are written as two digits. Work goes block by block in numpy, and every array as
long as the text is a spool, which moves to disk beyond its share of memory.
"""

from __future__ import annotations

import os
import shutil

import numpy as np

from .common import cpu_local_dir

#: Tuples of a block, symbols of one range of the queue, most symbols of a string, and symbols of a reduced string
#: (never of the text itself) that is short enough to be sorted in memory; a longer one is induced from a further reduction.
BLOCK, RANGE, SYMBOLS, SHORT = 1 << 15, 64, 1 << 12, 1 << 21
FAR = np.int32(1 << 30)


class Room:
    """Memory that spools and queues may use together, and the folder for what goes beyond it."""

    def __init__(self, memory: int = 256 << 20):
        self.memory, self.used, self.folder, self.files = memory, 0, None, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = cpu_local_dir()
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Spool:
    """An array that grows at its end; on disk once the room is used up."""

    def __init__(self, room: Room, kind):
        self.room, self.kind, self.parts, self.file, self.size = room, np.dtype(kind), [], None, 0

    def append(self, block: np.ndarray) -> None:
        block = np.ascontiguousarray(block, self.kind)
        self.size += len(block)
        self.parts.append(block)
        self.room.used += block.nbytes
        if self.room.used > self.room.memory:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            self.file = self.file or self.room.path()
            with open(self.file, "ab") as out:
                for block in self.parts:
                    block.tofile(out)
            self.forget()

    def forget(self) -> None:
        self.room.used -= sum(x.nbytes for x in self.parts)
        self.parts = []

    def array(self) -> np.ndarray:
        if not self.size:
            return np.zeros(0, self.kind)
        if self.file:
            self.flush()
            return np.memmap(self.file, self.kind, "r", shape=(self.size,))
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def drop(self) -> None:
        self.forget()
        if self.file:
            os.unlink(self.file)


class Queue:
    """Tuples in order of symbol and arrival. Symbols are taken in ascending order; a pushed symbol is
    never less than the one taken last. Ranges of symbols that are still ahead are spools."""

    def __init__(self, room: Room, symbols: int):
        self.ahead = [[Spool(room, np.int32) for _ in range(3)] if k * RANGE < symbols else None for k in range(-(-symbols // RANGE))]
        self.room, self.now, self.buckets = room, -1, {}

    def push(self, symbol: np.ndarray, position: np.ndarray, shared: np.ndarray) -> None:
        """The tuples come sorted by symbol; those of one symbol in order of arrival."""
        if not len(symbol):
            return
        cuts = np.flatnonzero(np.diff(symbol // RANGE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbol)]):
            k = int(symbol[a]) // RANGE
            if k == self.now:
                inner = np.flatnonzero(np.diff(symbol[a:b])) + 1 + a
                for i, j in zip([a, *inner.tolist()], [*inner.tolist(), b]):
                    self.buckets.setdefault(int(symbol[i]), []).append((position[i:j], shared[i:j]))
            else:
                for spool, x in zip(self.ahead[k], (symbol, position, shared)):
                    spool.append(x[a:b])

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of the symbol that have arrived; later ones are taken by another call."""
        while self.now < symbol // RANGE:
            self.now += 1
            spools = self.ahead[self.now]
            symbols, position, shared = (np.array(x.array()) for x in spools)
            for x in spools:
                x.drop()
            self.ahead[self.now] = None
            if len(symbols):
                order = np.argsort(symbols, kind="stable")
                self.push(symbols[order], position[order], shared[order])
        found = self.buckets.pop(symbol, None)
        if not found:
            none = np.zeros(0, np.int32)
            return none, none
        if len(found) == 1:
            return found[0]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Scan:
    """Pushes what scanned tuples induce: the suffix one place to the left, if it has the wanted type."""

    def __init__(self, text, wanted, queue: Queue, symbols: int, most: int, flip: bool, track: bool = True):
        self.track = track
        self.text, self.wanted, self.queue, self.most, self.flip, self.symbols = text, wanted, queue, most, flip, symbols
        self.least = np.full(symbols, FAR, np.int32)  # least common prefix scanned since a symbol's last push
        self.seen = np.zeros(symbols, bool)

    def feed(self, position: np.ndarray, shared: np.ndarray) -> None:
        for k in range(0, len(position), BLOCK):
            self._feed(position[k : k + BLOCK], shared[k : k + BLOCK])

    def _feed(self, position: np.ndarray, shared: np.ndarray) -> None:
        left = position - 1
        at = np.flatnonzero((position > 0) & self.wanted[np.maximum(left, 0)])
        if not self.track:
            symbol = self.text[left[at]].astype(np.int32)
            if self.flip:
                symbol = self.symbols - 1 - symbol
            order = np.argsort(symbol.astype(np.int16) if self.symbols < 1 << 15 else symbol, kind="stable")
            at = at[order]
            self.queue.push(symbol[order], left[at].astype(np.int32), shared[at])
            return
        low = np.minimum.accumulate(shared)
        if not len(at):
            np.minimum(self.least, low[-1], out=self.least)
            return
        symbol = self.text[left[at]].astype(np.int32)
        if self.flip:
            symbol = self.symbols - 1 - symbol
        order = np.argsort(symbol.astype(np.int16) if self.symbols < 1 << 15 else symbol, kind="stable")
        symbol, at = symbol[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        value = np.empty(len(at), np.int32)
        head = np.flatnonzero(new)
        heads = symbol[head]
        value[head] = np.minimum(self.least[heads], low[at[head]])
        rest = np.flatnonzero(~new)
        if len(rest):
            value[rest] = _range_min(shared, at[rest - 1] + 1, at[rest] + 1)
        value = np.minimum(value, FAR - 1) + 1
        np.minimum(value, self.most, out=value)
        value[head[~self.seen[heads]]] = 0
        self.seen[heads] = True
        tail = np.append(head[1:], len(at)) - 1
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], FAR)
        np.minimum(self.least, low[-1], out=self.least)
        self.least[heads] = after[at[tail] + 1]
        self.queue.push(symbol, left[at].astype(np.int32), value)


def _range_min(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of x[begin:end], each of one element at least, from minima over powers of two."""
    size = end - begin
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(begin), x.dtype)
    row = x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:]) if len(row) > half else row
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(row[begin[here]], row[end[here] - (1 << k)])
    return out


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, at most `most`, known to be `shared` or more."""
    out = np.minimum(shared, most).astype(np.int32)
    n, live = len(text), np.arange(len(a))
    while len(live):
        live = live[(out[live] < most) & (a[live] + out[live] < n) & (b[live] + out[live] < n)]
        same = text[a[live] + out[live]] == text[b[live] + out[live]]
        live = live[same]
        out[live] += 1
    return out


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: less than the one after. The last one, the least of all, is S-type."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))  # 1: less than the next symbol
    place = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, bool)
    inner = ahead < n
    out[:-1][inner] = step[ahead[inner]] > 0
    return out


def _starts(text, order, symbols: int) -> np.ndarray:
    """Where each symbol's seeds begin, for seeds in the order of their symbols."""
    return np.concatenate(([0], np.cumsum(np.bincount(text[order], minlength=symbols))))


def induce(text: np.ndarray, s_type: np.ndarray, symbols: int, seeds: np.ndarray, seed_shared: np.ndarray | None, most: int, room: Room):
    """Blocks of all suffixes in descending order, each with the common prefix it has with the one before.

    seeds: the LMS suffixes in ascending order; seed_shared: with the seed before;
    if it is None, common prefixes are not kept.
    """
    track = seed_shared is not None
    present = np.flatnonzero(np.bincount(text, minlength=symbols))
    queue, l_type = Queue(room, symbols), ~s_type
    scan = Scan(text, l_type, queue, symbols, most, False, track)
    spools, begins = (Spool(room, np.int32), Spool(room, np.int32)), {}
    starts = _starts(text, seeds, symbols)
    for c in present.tolist():
        begins[c] = spools[0].size
        last = None
        while True:
            position, shared = queue.take(c)
            if not len(position):
                break
            spools[0].append(position), spools[1].append(shared)
            last = int(position[-1])
            scan.feed(position, shared)
        part = slice(int(starts[c]), int(starts[c + 1]))
        if part.stop > part.start:
            shared = np.array(seed_shared[part], np.int32) if track else np.zeros(part.stop - part.start, np.int32)
            shared[0] = 0 if last is None or not track else extend(text, np.array([last]), np.array(seeds[part.start : part.start + 1]), np.zeros(1, np.int32), most)[0]
            scan.feed(np.array(seeds[part], np.int32), shared)
    l_position, l_shared = spools[0].array(), spools[1].array()
    queue = Queue(room, symbols)
    scan = Scan(text, s_type, queue, symbols, most, True, track)
    end = spools[0].size
    for c in present[::-1].tolist():
        last = None
        while True:
            position, shared = queue.take(symbols - 1 - c)
            if not len(position):
                break
            last = int(position[-1])
            yield position, shared
            scan.feed(position, shared)
        begin = begins[c]
        first = True
        for k in range(end, begin, -BLOCK):
            low = max(begin, k - BLOCK)
            position = np.array(l_position[low:k][::-1])
            # An ascending tuple's common prefix is with the one before it, which comes after it here.
            shared = np.empty(len(position), np.int32)
            shared[1:] = l_shared[low + 1 : k][::-1]
            if not first:
                shared[0] = l_shared[k]
            else:
                shared[0] = 0 if last is None or not track else extend(text, np.array([last]), position[:1], np.zeros(1, np.int32), most)[0]
            first = False
            yield position, shared
            scan.feed(position, shared)
        end = begin
        if c == 0:
            yield np.array([len(text) - 1], np.int32), np.zeros(1, np.int32)
    for x in spools:
        x.drop()


def _short(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending suffixes and common prefixes, by prefix doubling of those that aren't alone yet.

    Suffixes that share `most` symbols come together, in any order.
    """
    n, step = len(text), 1
    live = np.argsort(text, kind="stable")
    place = np.arange(n)
    equal = np.zeros(n, bool)
    equal[1:] = text[live[1:]] == text[live[:-1]]
    order, rank = live.copy(), np.full(n + 1, -1, np.int64)
    rank[live] = np.maximum.accumulate(np.where(equal, 0, place))
    shared, levels = np.full(n, min(most, n), np.int32), []
    shared[place[~equal]] = 0
    while step < most:
        keep = equal.copy()
        keep[:-1] |= equal[1:]
        live, place = live[keep], place[keep]
        if not len(live):
            break
        levels.append(rank.astype(np.int32))
        group = rank[live]
        key = group * (n + 1) + rank[np.minimum(live + step, n)] + 1
        turn = np.argsort(key, kind="stable")
        live, key = live[turn], key[turn]
        equal = np.zeros(len(live), bool)
        equal[1:] = key[1:] == key[:-1]
        apart = np.flatnonzero(~equal[1:] & (key[1:] // (n + 1) == key[:-1] // (n + 1))) + 1
        a, b = live[apart - 1], live[apart]
        found = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = levels[k][np.minimum(a + found, n)], levels[k][np.minimum(b + found, n)]
            found += ((x >= 0) & (x == y)) * (1 << k)
        shared[place[apart]] = np.minimum(found, most)
        order[place] = live
        rank[live] = np.maximum.accumulate(np.where(equal, 0, place))
        step *= 2
    return order.astype(np.int32), shared


def lms_order(text: np.ndarray, s_type: np.ndarray, symbols: int, most: int, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in ascending order, each with the common prefix it has with the one before."""
    is_lms = np.zeros(len(text), bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return lms, np.zeros(len(lms), np.int32)
    rough = lms[np.argsort(text[lms], kind="stable")]
    found = Spool(room, np.int32)
    for position, _ in induce(text, s_type, symbols, rough, None, most, room):
        found.append(position[is_lms[position]])
    order = np.array(found.array()[::-1], np.int64)
    found.drop()
    number = np.searchsorted(lms, order)
    stop = np.append(lms[1:], len(text) - 1) - lms + 1  # symbols of each LMS substring, with the next LMS's first
    length = stop[number]
    new = np.ones(len(order), bool)
    maybe = np.flatnonzero(length[1:] == length[:-1]) + 1
    a, b = order[maybe - 1], order[maybe]
    live, k = np.arange(len(maybe)), 0
    same = np.zeros(len(maybe), bool)
    size = length[maybe]
    while len(live):
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        done = size[live] <= k
        same[live[done]] = True
        live = live[~done]
    new[maybe[same]] = False
    if new.all():
        shared = np.zeros(len(order), np.int32)
        shared[1:] = extend(text, order[:-1], order[1:], np.zeros(len(order) - 1, np.int32), most)
        return order, shared
    name = np.empty(len(order), np.int64)
    name[number] = np.cumsum(new) - 1
    names = int(new.sum())
    if names <= SYMBOLS:
        rank, together = suffix_order(name.astype(np.int32), names, most, room, True)
        rank = np.array(rank, np.int64)
        together = np.array(together, np.int64)
    else:
        digits = -(-max(names.bit_length() - 1, 1) // 12) if names > SYMBOLS else 1
        base = 1 << -(-names.bit_length() // digits)
        columns = [name // base**d % base + 1 for d in range(digits - 1, -1, -1)]
        written = np.append(np.stack(columns, axis=1).reshape(-1), 0).astype(np.int32)
        rank, together = suffix_order(written, base + 1, most * digits, room, True)
        rank, together = np.array(rank, np.int64), np.array(together, np.int64)
        head = np.flatnonzero((rank % digits == 0) & (rank < len(written) - 1))
        # Between two such suffixes the common prefix is the least on the way.
        together = np.minimum.reduceat(together, np.concatenate(([0], head[:-1] + 1)))[: len(head)] if len(head) else together[:0]
        rank = rank[head] // digits
        together = together // digits
    sorted_lms = lms[rank]
    reach = np.minimum(rank + together, len(lms) - 1)
    shared = np.zeros(len(rank), np.int64)
    shared[1:] = (lms[reach] - lms[rank])[1:]
    shared[1:] = extend(text, sorted_lms[:-1], sorted_lms[1:], shared[1:], most)
    return sorted_lms, shared.astype(np.int32)


def descending(text: np.ndarray, symbols: int, most: int, room: Room, reduced: bool = False):
    """Blocks of all suffixes in descending order, each with the common prefix it has with the one before,
    at most `most`. The text's last symbol is 0 and is nowhere else; `reduced`: its symbols are names."""
    if reduced and len(text) <= SHORT:
        order, shared = _short(text, most)
        yield order[::-1], np.append(shared[1:], 0)[::-1].astype(np.int32)
        return
    s_type = types(text)
    seeds, shared = lms_order(text, s_type, symbols, most, room)
    yield from induce(text, s_type, symbols, seeds, shared, most, room)


def suffix_order(text: np.ndarray, symbols: int, most: int, room: Room, reduced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in ascending order, and the common prefix of each with the one before."""
    spools = Spool(room, np.int32), Spool(room, np.int32)
    for position, shared in descending(text, symbols, most, room, reduced):
        spools[0].append(position), spools[1].append(shared)
    position, shared = (x.array() for x in spools)
    return position[::-1], np.concatenate((np.zeros(1, np.int32), shared[::-1][:-1]))
