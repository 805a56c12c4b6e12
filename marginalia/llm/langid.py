"""Language identification by interpolated Kneser-Ney character models.

One model of order `ORDER` per language, over letters folded to lower case with anything else as one
boundary. Its n-grams are hashed; each order keeps sorted arrays of hashes with the discounted
probability of the n-gram and the back-off weight of its context. A text goes to the language with the
lowest cross-entropy per character; a text that the best model explains worse than nearly all texts of its language that
a model of the others was not fitted on is marked as rejected, while the prediction stays the best one.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import learned, mixed, pieces, utf8

ORDER, DISCOUNT = 4, 0.75
#: Documents of each language that a model is trained on, at most: those with the least hash of their text.
SAMPLE = 1500
#: Share of a language's texts outside a fit that may lie above its rejection threshold, and one text in so many that is outside.
REJECTED_SHARE, FOLDS = 0.001, 4
#: Bits of a letter's code, so that an n-gram is one 64-bit number: room for all letters of the training texts, of any script.
BITS = 16
#: Sharpness of the score: the softmax of minus the cross-entropy per character times this.
SHARPNESS = 8.0

_HELD, _OUT = 4, 2


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each text after a boundary (0), and where each begins.

    All that is no letter is a boundary, and boundaries in a row are one.
    """
    joined = "\n" + "\n".join(t.lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    starts = np.flatnonzero(points == 10)
    letter = _is_letter(points)
    folded = np.where(letter, points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    keep[starts] = True
    begin = np.cumsum(keep) - 1
    return folded[keep], begin[starts]


_letters = np.zeros(0, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalpha() for c in range(0x30000)])
    return _letters[np.minimum(points, len(_letters) - 1)]


class Model:
    """The models of all languages, over one alphabet."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.languages = order, sorted(texts)
        folded = {lang: fold(t) for lang, t in texts.items()}
        letters, counts = np.unique(np.concatenate([x for x, _ in folded.values()]) if folded else np.zeros(0, np.uint32), return_counts=True)
        counts, letters = counts[letters > 0], letters[letters > 0]
        best = np.sort(letters[np.argsort(-counts, kind="stable")][: (1 << BITS) - 2])
        self.size = len(best) + 2  # with the boundary and letters that no training text has
        self.code = np.full(0x30000, len(best) + 1, np.uint16)
        self.code[0] = 0
        self.code[np.minimum(best, len(self.code) - 1)] = np.arange(1, len(best) + 1)
        self.tables, self.limits = {}, {}
        for lang, (x, begin) in folded.items():
            self.tables[lang] = self._fit(self.codes(x), begin, discount)
            self.limits[lang] = self._limit(self.codes(x), begin, discount)

    def _limit(self, codes: np.ndarray, begin: np.ndarray, discount: float) -> float:
        """The entropy that all but a small share of a language's texts stay below in a fit on the others."""
        n = len(begin)
        if n < FOLDS:
            return np.inf
        number = np.repeat(np.arange(n), np.diff(np.append(begin, len(codes))))
        out = number % FOLDS == 0
        held, held_at = codes[out], np.flatnonzero(np.append(True, np.diff(number[out]) != 0)) if out.any() else begin[:0]
        fitted = self._fit(codes[~out], np.flatnonzero(np.append(True, np.diff(number[~out]) != 0)), discount)
        bits = -self._log2(fitted, self.grams(held, self.order))
        bits[held_at] = 0
        size = np.diff(np.append(held_at, len(held))) - 1
        sums = np.add.reduceat(bits, held_at)[size > 0]
        return float(np.quantile(sums / size[size > 0], 1 - REJECTED_SHARE)) if len(sums) else np.inf

    def codes(self, folded: np.ndarray) -> np.ndarray:
        return self.code[np.minimum(folded, len(self.code) - 1)]

    def grams(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The number of the n-gram that ends at each place; places before the first read as boundaries."""
        out = np.zeros(len(codes), np.uint64)
        for back in range(n - 1, -1, -1):
            out <<= np.uint64(BITS)
            out[back:] |= codes[: len(codes) - back]
        return out

    def _fit(self, codes: np.ndarray, begin: np.ndarray, d: float) -> list[tuple]:
        """For each order: sorted n-gram hashes with discounted probabilities, and sorted context hashes with back-off weights."""
        scored = np.ones(len(codes), bool)
        scored[begin] = False
        found, counts = np.unique(self.grams(codes, self.order)[scored], return_counts=True)
        tables = []
        for n in range(self.order, 0, -1):
            context = found >> np.uint64(BITS)
            groups, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, counts, len(groups))
            types = np.bincount(where, minlength=len(groups))
            p = np.maximum(counts - d, 0) / total[where]
            tables.append((*_sorted(found, p), *_sorted(groups, d * types / total)))
            # Kneser-Ney: a lower order counts the contexts that its n-gram follows.
            low = found & _ends_with(n - 1) if n > 1 else found[:0]
            found, counts = np.unique(low, return_counts=True)
        return tables[::-1]

    def log_probability(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last character after the others."""
        return self._log2(self.tables[lang], grams)

    def _log2(self, tables: list[tuple], grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1.0 / self.size)
        for n, (keys, values, contexts, weights) in enumerate(tables, 1):
            gram = grams & _ends_with(n)
            p = _lookup(keys, values, gram, 0.0) + _lookup(contexts, weights, gram >> np.uint64(BITS), 1.0) * p
        return np.log2(p)

    def entropies(self, folded: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Bits per character of each text under each language; a text without letters gets zeros."""
        grams, which = np.unique(self.grams(self.codes(folded), self.order), return_inverse=True)
        n = np.diff(np.append(begin, len(folded))) - 1
        out = np.zeros((len(begin), len(self.languages)))
        for k, lang in enumerate(self.languages):
            bits = -self.log_probability(lang, grams)[which]
            bits[begin] = 0
            sums = np.add.reduceat(bits, begin) if len(begin) else np.zeros(0)
            out[n > 0, k] = sums[n > 0] / n[n > 0]
        return out


def _ends_with(n: int) -> np.uint64:
    """Keeps the last n letters of an n-gram's number."""
    return np.uint64((1 << (BITS * n)) - 1)


def _hash(x: np.ndarray) -> np.ndarray:
    return mixed(x.astype(np.uint64) + np.uint64(1))


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hash(keys)
    order = np.argsort(h)
    return h[order], values[order]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    h = _hash(wanted)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], missing)


def train(docs: DataFrame, sample: int = SAMPLE) -> bytes:
    """The pickled models, from `sample` learned documents of each language with a known one, at most.

    The bound is the same for any input, so the sample fits on the driver. Equal texts count once.
    """
    known = docs.filter(learned(F.col("doc_id"), _HELD, _OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Copies are one text before anything is counted, drawn or ranked.
    pick = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h")).distinct()
    languages = pick.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A threshold on the hash keeps about twice the sample, whatever the language's size, before the exact top.
    share = languages.select(F.col("lang").alias("l"), (2.0 * sample / F.col("n")).alias("share"))
    unit = (F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40))
    few = pick.join(share, F.col("lang") == F.col("l")).filter(unit <= F.col("share")).select("lang", "h")
    turn = Window.partitionBy("lang").orderBy("h")
    chosen = few.withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= sample).select(F.col("h").alias("_h"), F.col("lang").alias("_l"))
    texts = known.withColumn("_k", F.xxhash64("text")).join(F.broadcast(chosen), (F.col("_k") == F.col("_h")) & (F.col("lang") == F.col("_l")))
    rows = texts.groupBy("_l", "_k").agg(F.min("text").alias("text")).select("_l", "text").toPandas()
    return pickle.dumps(Model({lang: sorted(g["text"]) for lang, g in rows.groupby("_l")}))


_models: dict[int, Model] = {}


def _predict(batches, shared):
    data = shared.value
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(data)
    model = _models[key]
    names = np.array(model.languages + ["und"], object)
    limits = np.array([model.limits[x] for x in model.languages])
    for part in pieces(batches, "text"):
        texts = [t or "" for t in part.column(1).to_pylist()]
        folded, begin = fold(texts)
        entropy = model.entropies(folded, begin)
        lettered = np.add.reduceat(folded > 0, begin, dtype=np.int64) > 0
        if model.languages:
            best = np.argmin(entropy, axis=1)
            weight = np.exp2(-SHARPNESS * (entropy - entropy.min(axis=1, keepdims=True)))
            score = np.where(lettered, 1 / weight.sum(axis=1), 0.0)
            low = entropy[np.arange(len(best)), best]
            rejected = ~lettered | (low > limits[best])
        else:
            best, score, low, rejected = np.full(len(texts), 0), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = np.where(lettered, best, len(model.languages))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"])


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_char, rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is any text where no
    language was learned. A null doc_id is not held out. Only text and doc_id are read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (~learned(F.col("doc_id"), _HELD, _OUT)).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim.mapInArrow(partial(_predict, shared=shared), "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the table and predicts for all of it: one row per document, as `identify` gives them.

    Rows that repeat are predicted alike and trained on once; where languages tie, the first by name is predicted. A text of any length is
    read whole. An empty table gives no rows, and one without a known language `und` for all.
    """
    return identify(docs, train(docs, sample))
