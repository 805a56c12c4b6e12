"""Quality classifier: a factorisation machine over hashed words, structure figures and metadata.

A text's features are its words, hashed to `BUCKETS` with the root of their share of the text as values, figures
of its structure (binned, each bin a feature), and its length in characters as metadata. The score is
the logistic of a bias, linear weights and low-rank pairwise interactions; these are summed in linear
time as half the square of the factor sums minus the sum of squares.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learned, pieces, span_hashes, utf8, word_spans

BUCKETS, RANK = 1 << 14, 8
#: Labelled documents that the model is trained on, at most: those with the least hash of doc_id and text.
SAMPLE = 6000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-5
#: Least score of a document that is predicted to be good.
THRESHOLD = 0.3
BINS = 12

_HELD, _OUT = 5, 0
_KINDS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)), "lower": np.isin(np.arange(256), np.arange(97, 123)), "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8)), "stop": np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8)),
    "shout": np.arange(256) == 33, "wide": np.arange(256) >= 128, "line": np.arange(256) == 10, "bar": np.arange(256) == 124,
}
FIGURES = [*_KINDS, "word_length", "distinct", "commonest", "length", "words", "chars_meta"]


def features(column, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts joined, and where each text's begin (one more than texts).

    The figures' bins come first: figure k has the numbers k * BINS on.
    """
    raw, at = utf8(column)
    begin, end, first = word_spans(raw, at)
    docs, n = len(at) - 1, np.diff(first)
    base = len(FIGURES) * BINS
    hashed = span_hashes(raw, begin, end)
    # Each (text, bucket) once, with its count.
    owner = np.repeat(np.arange(docs, dtype=np.uint64), n)
    pairs, counts = np.unique(owner * np.uint64(BUCKETS) + hashed % np.uint64(BUCKETS), return_counts=True)
    pair_doc, bucket = (pairs // np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)
    distinct = np.bincount(pair_doc, minlength=docs)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, pair_doc, counts)
    size = np.maximum(np.diff(at), 1)
    words = np.maximum(n, 1)
    spread = lambda x, least, top: np.clip(np.log2(np.maximum(x, 1e-9) / least) / np.log2(top / least), 0, 1)
    shares = [np.diff(np.concatenate(([0], np.cumsum(kind[raw])))[at]) / size for kind in _KINDS.values()]
    chars = np.concatenate(([0], np.cumsum(end - begin)))
    scaled = [spread(s, 1 / 512, 1.0) * (s > 0) for s in shares]
    scaled += [np.clip(np.diff(chars[first]) / words / 16, 0, 1), np.where(n > 0, distinct / words, 0), spread(most / words, 1 / 64, 1.0), spread(size, 16, 1 << 17), spread(words, 4, 1 << 15), spread(n_chars, 16, 1 << 17)]
    bins = np.stack([np.minimum((s * BINS).astype(np.int64), BINS - 1) + k * BINS for k, s in enumerate(scaled)], axis=1)
    ids = np.concatenate((bins.reshape(-1), bucket + base))
    values = np.concatenate((np.full(bins.size, len(FIGURES) ** -0.5), np.sqrt(counts / words[pair_doc])))
    doc = np.concatenate((np.repeat(np.arange(docs), len(FIGURES)), pair_doc))
    order = np.argsort(doc, kind="stable")
    return ids[order], values[order].astype(np.float32), np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs))))


class FactorisationMachine:
    def __init__(self, size: int, rank: int = RANK, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, ids, values, first):
        """The score before the logistic, and the factor sums of each text."""
        v = self.v[ids] * values[:, None]
        starts = first[:-1]
        sums, squares = np.add.reduceat(v, starts, axis=0), np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def probability(self, ids, values, first) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, first)[0].astype(np.float64), -30, 30)))

    def fit(self, ids, values, first, labels, epochs=EPOCHS, seed=5) -> None:
        """AdaGrad over shuffled batches; no epochs for an empty sample."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-4), np.full_like(self.v, 1e-4), 1e-4
        share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs if len(labels) else 0):
            turn = rng.permutation(len(labels))
            for k in range(0, len(turn), BATCH):
                part = turn[k : k + BATCH]
                n = first[part + 1] - first[part]
                at = np.repeat(first[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, x, f = ids[at], values[at], np.concatenate(([0], np.cumsum(n)))
                z, sums = self.raw(i, x, f)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
                each = np.repeat(error, n).astype(np.float32) * x
                dv = each[:, None] * (np.repeat(sums, n, axis=0) - self.v[i] * x[:, None])
                own, where = np.unique(i, return_inverse=True)
                order = np.argsort(where, kind="stable")
                starts = np.searchsorted(where[order], np.arange(len(own)))
                w = np.add.reduceat(each[order], starts) + DECAY * self.w[own]
                v = np.add.reduceat(dv[order], starts, axis=0) + DECAY * self.v[own]
                gw[own] += w * w
                gv[own] += v * v
                gb += error.sum() ** 2
                self.w[own] -= RATE * 4 * w / np.sqrt(gw[own])
                self.v[own] -= RATE * v / np.sqrt(gv[own])
                self.bias -= RATE * error.sum() / np.sqrt(gb)


def _sparse(batches):
    for part in pieces(batches, "text"):
        ids, values, first = features(part.column(0), part.column(1).fill_null(0).to_numpy(zero_copy_only=False))
        cut = pa.array(first, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(values)), part.column(2)], names=["ids", "weights", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """The machine, from `sample` labelled documents that aren't held out, at most.

    The bound is the same for any input, so the sample's features fit on the driver. Labels other
    than 0 and 1, and labels of no document, are passed over; a document with both labels counts as both.
    """
    marked = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality")).distinct().filter(learned(F.col("_id"), _HELD, _OUT))
    n = marked.count()
    few = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, 1.5 * sample / max(n, 1))))
    chosen = few.orderBy(F.xxhash64("_id", F.lit(3)), "quality").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.length("text").cast("bigint").alias("n")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = rows.select("text", "n", "quality").mapInArrow(_sparse, "ids array<int>, weights array<float>, quality double").toArrow()
    machine = FactorisationMachine(len(FIGURES) * BINS + BUCKETS)
    ids, first = found.column("ids").combine_chunks(), None
    if found.num_rows:
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        weights = found.column("weights").combine_chunks()
        weights = pa.concat_arrays(weights.chunks) if isinstance(weights, pa.ChunkedArray) else weights
        first = ids.offsets.to_numpy().astype(np.int64)
        machine.fit(ids.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy(), first - first[0], found.column("quality").to_numpy())
    return machine


def _score(batches, shared, threshold: float):
    machine = shared.value
    for part in pieces(batches, "text", 2 << 20):
        ids, values, first = features(part.column(1), part.column(2).fill_null(0).to_numpy(zero_copy_only=False))
        p = machine.probability(ids, values, first)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher is better), predicted.

    A null text scores as an empty one. A null doc_id is not held out. Rows are independent, so
    repeats repeat; an empty table gives no rows. Only doc_id and text are read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.length("text").cast("bigint").alias("n"), (~learned(F.col("doc_id"), _HELD, _OUT)).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return slim.mapInArrow(partial(_score, shared=shared, threshold=threshold), "doc_id bigint, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return quality(docs, train(docs, labels, sample))
