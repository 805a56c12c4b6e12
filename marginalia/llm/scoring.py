"""Scoring of texts by a causal self-attention model over subword ids.

The text's words, lower-cased, are written as ids of a public byte-level vocabulary. Each id has a
class; the model gives the next class, and corpus counts give the id within its class after the class
before it, so that all ids have a probability and these sum to one. The class model adds what one
masked attention layer finds in the ids before to the log-probability of the class after the class
before it, which is counted over the whole corpus. Texts are laid out in blocks: each block attends
to itself and the block before, so that windows overlap by half and every id is scored once.
A word's probability is half that of its ids, and that it ends there, and half its share of all training tokens,
so that words that the corpus has often are not only spelled.

Counts come from all words of all training texts. The attention weights are trained by local steps of
Adam on all partitions over every passage of the training texts, once a round at any size, averaged
after each round.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import learned, lower_ascii, mixed, pieces, ranges, span_hashes, utf8, word_spans, written

_HELD, _OUT = 7, 2
#: Bytes of text for each block of documents.
PART_BYTES = 12 << 20
#: Buckets that the blocks are kept in, at most; a bucket may have many blocks, each worked on by itself.
BUCKETS = 50_000
#: Width of the layer, tokens of a block, classes of word-initial and of other ids, and ids with an embedding of their own.
WIDTH, SPAN, HEADS, INNER, OWN = 16, 16, 40, 87, 2048
#: Texts are trained on in passages of `PASSAGE` words, each once in each of `ROUNDS` rounds, in batches of `BATCH` passages.
PASSAGE, ROUNDS, BATCH, RATE = 48, 1, 16, 1e-2
#: Words that a worker keeps the ids of, and bytes of text that are worked on at once.
KEEP_WORDS, PIECE = 200_000, 2 << 20
#: Share of a word's probability that comes from its count among the training tokens, not from the model of its ids.
MIX = 0.5
#: Hash buckets that a neighbour id is counted by, to group ids into classes.
SIDES = 61
SEED = 3


def word_counts(batches):
    """(block, word, n): the words of each block, with how often its training texts have them."""
    for part in pieces(batches, "text", PIECE):
        raw, at = utf8(part.column(2))
        raw = lower_ascii(raw)
        begin, end, first = word_spans(raw, at)
        if not len(begin):
            continue
        block = np.repeat(part.column(0).to_numpy(), np.diff(first))
        train = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(first))
        _, one, which = np.unique(span_hashes(raw, begin, end) ^ mixed(block.astype(np.uint64) + np.uint64(9)), return_index=True, return_inverse=True)
        data = raw.tobytes()
        words = pa.array([data[a:b].decode() for a, b in zip(begin[one].tolist(), end[one].tolist())], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(block[one]), words, pa.array(np.bincount(which, train, len(one)).astype(np.int64))], names=["block", "word", "n"])


def _ids(coder, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, each after a space, and how many each has."""
    if len(coder.known) > KEEP_WORDS:
        coder.forget()
    number = np.array([coder.number(b" " + w.encode()) for w in words], np.int64)
    every = np.array(coder.sizes, np.int64)
    flat = np.array(coder.ids, np.uint32)
    sizes = every[number]
    return flat[np.repeat((np.cumsum(every) - every)[number], sizes) + ranges(sizes)].astype(np.int64), sizes


def _sides(batches, path: str):
    """(id, side, n): how often each id stands beside an id of a bucket: after it, or for a word's first id, before it."""
    coder, size = encoder(path), None
    counts = np.zeros(len(coder.bytes) * SIDES)
    for batch in batches:
        ids, sizes = _ids(coder, batch.column(0).to_pylist())
        if not len(ids):
            continue
        n = np.repeat(batch.column(1).to_numpy(), sizes)
        start = ranges(sizes) == 0
        beside = np.where(start, np.append(ids[1:], 0), np.append(0, ids[:-1])) % (SIDES - 1) + 1
        alone = start & np.append(start[1:], True)
        beside[alone] = 0
        counts += np.bincount(ids * SIDES + beside, n, len(counts))
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there // SIDES), pa.array(there % SIDES), pa.array(counts[there].astype(np.int64))], names=["id", "side", "n"])


def _pairs(batches, path: str, shared):
    """(before, id, n): ids after an id of a class within words; ids of -1 count words that end in the class."""
    coder, class_of = encoder(path), shared.value
    classes, size = int(class_of.max()) + 1, len(coder.bytes)
    counts = np.zeros(classes * (size + 1))
    for batch in batches:
        ids, sizes = _ids(coder, batch.column(0).to_pylist())
        if not len(ids):
            continue
        n = np.repeat(batch.column(1).to_numpy(), sizes)
        place = ranges(sizes)
        inner = np.flatnonzero(place > 0)
        counts += np.bincount(class_of[ids[inner - 1]] * (size + 1) + ids[inner] + 1, n[inner], len(counts))
        last = np.cumsum(sizes) - 1
        counts += np.bincount(class_of[ids[last]] * (size + 1), n[last], len(counts))
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there // (size + 1)), pa.array(there % (size + 1) - 1), pa.array(counts[there].astype(np.int64))], names=["before", "id", "n"])


def _classes(counts: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The class of each id, and of the end (0), from its neighbour counts: the commonest ids have classes of
    their own, the others are grouped by likeness of their neighbours."""
    out = np.zeros(len(counts) + 1, np.int64)
    rng, offset, total = np.random.default_rng(SEED), 1, counts.sum(axis=1)
    for members, n in ((np.flatnonzero(initial), HEADS), (np.flatnonzero(~initial), INNER)):
        members = members[np.argsort(-total[members], kind="stable")]
        own = n // 2
        out[members[:own]] = offset + np.arange(len(members[:own]))
        rest, groups = members[own:], n - own
        if len(rest):
            used = rest[total[rest] > 0]
            profile = np.sqrt(counts[used] / np.maximum(total[used], 1)[:, None])
            centre = profile[np.linspace(0, max(min(len(used), 40 * groups) - 1, 0), groups).astype(int)] if len(used) else np.zeros((groups, SIDES))
            centre = centre + rng.normal(0, 1e-3, centre.shape)
            label = np.zeros(len(used), np.int64)
            for _ in range(8 if len(used) else 0):
                label = np.argmin((centre**2).sum(axis=1) - 2 * profile @ centre.T, axis=1)
                for g in range(groups):
                    inside = label == g
                    if inside.any():
                        centre[g] = np.average(profile[inside], axis=0, weights=np.log1p(total[used][inside]))
            out[rest] = offset + groups - 1 + own
            out[used] = offset + own + label
        offset += n
    out[-1] = 0
    return out


class Scorer:
    """Corpus tables and attention weights."""

    def __init__(self, sides: np.ndarray, initial: np.ndarray, class_of: np.ndarray, pairs: np.ndarray, finals: np.ndarray, texts: int):
        size = len(initial)
        self.class_of, self.end = class_of, size
        k = self.classes = 1 + HEADS + INNER
        total = sides.sum(axis=1)
        inside = np.full(size, 0.05) + total
        mass = np.bincount(class_of[:-1], inside, k)
        within = inside / mass[class_of[:-1]]
        # The id within its class: after the class before it where the corpus has that, else by the class alone.
        joint = np.zeros((k, k))
        for b in range(k):
            joint[b] = np.bincount(class_of[:-1], pairs[b], k)
        self.within = np.zeros((k, size + 1), np.float32)
        for b in range(k):
            p = (pairs[b] + 3.0 * within) / (joint[b] + 3.0)[class_of[:-1]]
            self.within[b, :-1] = np.log(np.where(initial, within, p))
        words = max(finals.sum(), 1.0)
        ending = texts / (words + texts) if texts else 0.5
        starts = np.bincount(class_of[:-1], np.where(initial, total, 0), k) + 0.05 * (np.arange(k) > 0) * (np.arange(k) <= HEADS)
        starts /= max(starts.sum(), 1e-9)
        after = np.concatenate(([0.0], finals[1:] * (1 - 0))) if len(finals) else np.zeros(k)
        nexts = joint + after[:, None] * ((1 - ending) * starts + ending * (np.arange(k) == 0))
        nexts[0] = words * starts
        usual = nexts.sum(axis=0) + 1.0
        nexts += 2.0 * usual / usual.sum()
        # A text with no words ends at once.
        nexts[0] += 1e-4 * nexts[0].sum() * (np.arange(k) == 0)
        self.bias = np.log(nexts / nexts.sum(axis=1, keepdims=True)).astype(np.float32)
        own = np.argsort(-total, kind="stable")[:OWN]
        self.row = OWN + class_of
        self.row[own] = np.arange(len(own))
        rng, d = np.random.default_rng(SEED), WIDTH
        self.weights = {
            "embed": rng.normal(0, 0.4, (OWN + k, d)), "query": rng.normal(0, d**-0.5, (d, d)), "key": rng.normal(0, d**-0.5, (d, d)), "value": rng.normal(0, d**-0.5, (d, d)),
            "near": np.zeros(2 * SPAN), "out": np.zeros((2 * d, k)),
        }
        self.weights = {n: w.astype(np.float32) for n, w in self.weights.items()}

    #: Distance from each query of a block to each key of the block before and its own; what may be seen.
    _distance = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]
    _hidden = np.where(_distance < 0, np.float32(-1e9), np.float32(0))
    _distance = np.clip(_distance, 0, 2 * SPAN - 1)

    def forward(self, w: dict, rows: np.ndarray, fresh: np.ndarray):
        """The layer over blocks of embedding rows; fresh blocks don't see the one before."""
        x = w["embed"][rows]
        n, d = len(rows), WIDTH
        q, k, v = (np.matmul(x.reshape(-1, d), w[m]).reshape(n, SPAN, d) for m in ("query", "key", "value"))
        both = lambda y: np.concatenate((np.concatenate((y[-1:], y[:-1])), y), axis=1)
        k2, v2 = both(k), both(v)
        s = np.matmul(q, k2.transpose(0, 2, 1)) * np.float32(d**-0.5)
        s += w["near"][self._distance] + self._hidden
        s[fresh, :, :SPAN] = -1e9
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        z = np.concatenate((x, np.matmul(s, v2)), axis=2).reshape(-1, 2 * d)
        return z, (x, q, k2, v2, s)

    def layout(self, ids: np.ndarray, counts: np.ndarray):
        """Blocks for texts of these ids: the places of their inputs, and which blocks are fresh."""
        blocks = -(-counts // SPAN)
        start = np.concatenate(([0], np.cumsum(blocks)))
        place = np.repeat(start[:-1] * SPAN, counts) + ranges(counts)
        fresh = np.zeros(start[-1], bool)
        fresh[start[:-1][blocks > 0]] = True
        return place, fresh, int(start[-1])

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's probability; inputs are the ids before them, the end before a text."""
        return self.logs(inputs, targets, counts)[0]

    def word_logs(self, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each word and end, whose ids begin at `starts`; `ends` says which are ends.

        A word is its ids and that no further one follows, given that a word or the end begins. `MIX` of its probability
        is its share of all training tokens.
        """
        p, stop = (x.astype(np.float64) for x in self.logs(inputs, targets, counts))
        after = np.append(stop[starts[1:]], 0.0)
        after[ends] = 0.0
        spelled = np.add.reduceat(p, starts) - stop[starts] + after
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(1 - MIX) + spelled, np.log(MIX) + np.log(shares))

    def logs(self, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, blocks_at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """`log_probabilities`, and in the same places the logarithm of the chance that a word or the end begins."""
        place, fresh, n = self.layout(inputs, counts)
        rows = np.full(n * SPAN, OWN, np.int64)
        rows[place] = self.row[inputs]
        rows = rows.reshape(n, SPAN)
        before = np.zeros(n * SPAN, np.int64)
        before[place] = self.class_of[inputs]
        wanted = np.zeros(n * SPAN, np.int64)
        wanted[place] = self.class_of[targets]
        out, stop = np.empty(n * SPAN, np.float32), np.empty(n * SPAN, np.float32)
        for k in range(0, n, blocks_at_once):
            low = max(k - 1, 0)
            own = slice(low, k + blocks_at_once)
            hidden = fresh[own].copy()
            hidden[0] = True  # its own result is dropped, or it is the first block of all
            z, _ = self.forward(self.weights, rows[own], hidden)
            z = z[(k - low) * SPAN :]
            part = slice(k * SPAN, k * SPAN + len(z))
            logits = z @ self.weights["out"]
            logits += self.bias[before[part]]
            top = logits.max(axis=1)
            picked = logits[np.arange(len(z)), wanted[part]]
            logits -= top[:, None]
            np.exp(logits, out=logits)
            whole = logits.sum(axis=1)
            out[part] = picked - top - np.log(whole)
            stop[part] = np.log(np.maximum(logits[:, : HEADS + 1].sum(axis=1) / whole, np.float32(1e-30)))
        return out[place] + self.within[self.class_of[inputs], targets], stop[place]

    def gradients(self, w: dict, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, scored: np.ndarray):
        place, fresh, n = self.layout(inputs, counts)
        rows = np.full(n * SPAN, OWN, np.int64)
        rows[place] = self.row[inputs]
        z, (x, q, k2, v2, s) = self.forward(w, rows.reshape(n, SPAN), fresh)
        d, zp = WIDTH, z[place]
        logits = zp @ w["out"] + self.bias[self.class_of[inputs]]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        at = np.arange(len(inputs)), self.class_of[targets]
        loss = -float(np.log(logits[at][scored]).sum())
        logits[at] -= 1
        logits *= (scored / np.float32(max(scored.sum(), 1)))[:, None].astype(np.float32)
        g = {"out": zp.T @ logits}
        dz = np.zeros_like(z)
        dz[place] = logits @ w["out"].T
        dz = dz.reshape(n, SPAN, 2 * d)
        dx, dh = dz[:, :, :d].copy(), dz[:, :, d:]
        da = np.matmul(dh, v2.transpose(0, 2, 1))
        dv2 = np.matmul(s.transpose(0, 2, 1), dh)
        ds = s * (da - (da * s).sum(axis=2, keepdims=True))
        g["near"] = np.bincount(self._distance.reshape(-1), ds.sum(axis=0).reshape(-1), 2 * SPAN).astype(np.float32)
        ds *= np.float32(d**-0.5)
        dq, dk2 = np.matmul(ds, k2), np.matmul(ds.transpose(0, 2, 1), q)
        fold = lambda y: y[:, SPAN:] + np.concatenate((y[1:, :SPAN], y[:1, :SPAN]))
        flat = x.reshape(-1, d)
        for name, dy in (("query", dq), ("key", fold(dk2)), ("value", fold(dv2))):
            dy = dy.reshape(-1, d)
            g[name] = flat.T @ dy
            dx += (dy @ w[name].T).reshape(dx.shape)
        own, which = np.unique(rows, return_inverse=True)
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(own)))
        embed = np.zeros_like(w["embed"])
        embed[own] = np.add.reduceat(dx.reshape(-1, d)[order], begin, axis=0)
        g["embed"] = embed
        return g, loss

    def steps(self, passages: list[np.ndarray], seed: int) -> tuple[dict, int]:
        """The weights after Adam's steps over the passages, and the ids seen."""
        w = {n: x.copy() for n, x in self.weights.items()}
        m, v = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
        rng, seen = np.random.default_rng(seed), 0
        turn = rng.permutation(len(passages))
        total = -(-len(turn) // BATCH)
        for t, k in enumerate(range(0, len(turn), BATCH), 1):
            batch = [passages[i] for i in turn[k : k + BATCH]]
            counts = np.array([len(p) - 1 for p in batch])
            inputs, targets = np.concatenate([p[:-1] for p in batch]), np.concatenate([p[1:] for p in batch])
            g, _ = self.gradients(w, inputs, targets, counts, np.ones(len(inputs), bool))
            seen += len(inputs)
            rate = RATE * (1 - 0.9 * t / total)
            for n in w:
                m[n] += 0.1 * (g[n] - m[n])
                v[n] += 0.01 * (g[n] * g[n] - v[n])
                w[n] -= (rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return w, seen


def _passages(batches, path: str):
    """Ids of the passages that are trained on: all of each training text's."""
    coder = encoder(path)
    for part in pieces(batches, "text", PIECE):
        part = part.filter(part.column(1))
        if not part.num_rows:
            continue
        raw, at = utf8(part.column(2))
        raw = lower_ascii(raw)
        begin, end, first = word_spans(raw, at)
        n = np.diff(first)
        many = -(-n // PASSAGE)
        doc, turn = np.repeat(np.arange(len(n)), many), ranges(many)
        start = first[:-1][doc] + turn * PASSAGE
        stop = np.minimum(start + PASSAGE, first[1:][doc])
        if not len(start):
            continue
        _, one, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        data = raw.tobytes()
        ids, sizes = _ids(coder, [data[a:b].decode() for a, b in zip(begin[one].tolist(), end[one].tolist())])
        each = sizes[which]
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which], each) + ranges(each)]
        cut = np.concatenate(([0], np.cumsum(each)))[np.append(start, stop[-1])]
        rows = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows], names=["ids"])


def _train(batches, shared, turn: int):
    """One row: the summed weights of this partition's steps, weighed by the ids seen."""
    model = pickle.loads(shared.value)
    passages = []
    for b in batches:
        ids, cut = b.column(0).values.to_numpy(), b.column(0).offsets.to_numpy()
        passages += [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()) if j - i > 1]
    if passages:
        w, seen = model.steps(passages, turn)
        flat = np.concatenate([w[n].reshape(-1) for n in sorted(w)]).astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([seen])], names=["weights", "seen"])


def _train_texts(batches, path: str, shared, turn: int):
    return _train(_passages(batches, path), shared, turn)


def _sum(batches):
    flat, seen = None, 0
    for b in batches:
        for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(x, np.float64)
            flat, seen = (x if flat is None else flat + x), seen + n
    if flat is not None:
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([seen])], names=["weights", "seen"])


def train_weights(model: Scorer, texts: DataFrame, path: str, rounds: int = ROUNDS) -> None:
    """Rounds of local steps over all passages, which are made from the texts again in each round; a partition's weights are summed with others' in two levels, so the driver gets a few rows."""
    context = texts.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(pickle.dumps(model))
        kind = "weights binary, seen bigint"
        found = texts.mapInArrow(partial(_train_texts, path=path, shared=shared, turn=turn), kind).repartition(6).mapInArrow(_sum, kind).toArrow()
        if not found.num_rows:
            return
        flat = sum(np.frombuffer(x.as_py(), np.float64) for x in found.column("weights")) / sum(found.column("seen").to_pylist())
        at = 0
        for n in sorted(model.weights):
            w = model.weights[n]
            model.weights[n] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size


def _score(key, texts: pa.Table, counts: pa.Table, path: str, shared, totals: tuple[int, int, int]) -> pa.Table:
    model, coder = shared.value, encoder(path)
    n_all, n_types, n_ends = totals
    words = counts.column("word").combine_chunks() if counts.num_rows else pa.array([], pa.string())
    raw, at = utf8(words)
    table = span_hashes(raw, at[:-1], at[1:])
    order = np.argsort(table)
    table, number = table[order], counts.column("c").to_numpy()[order] if counts.num_rows else np.zeros(0, np.int64)
    log10 = lambda c: np.log10((c + 1.0) / (n_all + (n_types + 1.0)))
    rows = []
    for part in pieces(texts.to_batches(), "text", PIECE):
        raw, at = utf8(part.column(part.schema.get_field_index("text")))
        raw = lower_ascii(raw)
        begin, end, first = word_spans(raw, at)
        hashes, one, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(table, hashes), max(len(table) - 1, 0))
        c = np.where(table[place] == hashes, number[place], 0)[which] if len(table) and len(hashes) else np.zeros(len(begin), np.int64)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
        base, known = sums(log10(c)) + log10(n_ends), sums(c > 0) + (n_ends > 0)
        data = raw.tobytes()
        ids, sizes = _ids(coder, [data[a:b].decode() for a, b in zip(begin[one].tolist(), end[one].tolist())])
        begins = np.cumsum(sizes) - sizes
        each = sizes[which]
        stream = ids[np.repeat(begins[which], each) + ranges(each)]
        upto = np.concatenate(([0], np.cumsum(each)))[first]
        lengths = np.diff(upto)
        total = np.zeros(len(lengths))
        if len(lengths):
            targets = np.insert(stream, upto[1:], model.end)
            inputs = np.insert(stream, upto[:-1], model.end)
            sizes = np.insert(each, first[1:], 1)
            shares = np.insert(c, first[1:], n_ends) / max(n_all, 1)
            p = model.word_logs(inputs, targets, lengths + 1, np.cumsum(sizes) - sizes, first[1:] + np.arange(len(lengths)), shares)
            total = np.add.reduceat(p, first[:-1] + np.arange(len(lengths))) / np.log(10)
        rows.append(pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc_id")), pa.array(~part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False)), pa.array(np.diff(first) + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(lengths), n_all)), pa.array(base), pa.array(total)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        ))
    return pa.Table.from_batches(rows, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is log10 of the model's probability of the lower-cased words and the end; base_score that of
    an add-one word model. A null text is empty: only its end is scored. A null doc_id is trained on.
    Repeated rows count each time. An empty table gives no rows. Only doc_id and text are read.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-n // PART_BYTES))
    slim = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("block"), learned(F.col("doc_id"), _HELD, _OUT).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    texts = written(slim, "block", min(parts, BUCKETS))
    own = Window.partitionBy("word")
    words = texts.select("block", "train", "text").mapInArrow(word_counts, "block bigint, word string, n bigint").repartition("word").groupBy("word", "block").agg(F.sum("n").alias("n"))
    words = written(words.select("block", "word", F.sum("n").over(own).alias("c"), (F.col("block") == F.min("block").over(own)).alias("first")), "block", min(parts, BUCKETS))
    types = words.filter("first and c > 0").select("word", "c")
    n_words, n_types = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_ends = texts.filter("train").count()
    coder = encoder(path)
    size = len(coder.bytes)
    initial = np.array([x[:1] == b" " for x in coder.bytes])
    found = types.mapInArrow(partial(_sides, path=path), "id bigint, side bigint, n bigint").groupBy("id", "side").agg(F.sum("n").alias("n")).toArrow()
    sides = np.zeros((size, SIDES))
    sides[found.column("id").to_numpy(), found.column("side").to_numpy()] = found.column("n").to_numpy()
    class_of = _classes(sides, initial)
    k = 1 + HEADS + INNER
    found = types.mapInArrow(partial(_pairs, path=path, shared=spark.sparkContext.broadcast(class_of)), "before bigint, id bigint, n bigint").groupBy("before", "id").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((k, size + 1))
    pairs[found.column("before").to_numpy(), found.column("id").to_numpy() + 1] = found.column("n").to_numpy()
    model = Scorer(sides, initial, class_of, pairs[:, 1:], pairs[:, 0], n_ends)
    train_weights(model, texts.select("block", "train", "text"), path)
    shared = spark.sparkContext.broadcast(model)
    totals = (int(n_words + n_ends), int(n_types + (n_ends > 0)), int(n_ends))
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(partial(_score, path=path, shared=shared, totals=totals), SCORED)
