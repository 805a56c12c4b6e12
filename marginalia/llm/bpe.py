"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut before a space wherever a rolling hash of the bytes before it allows, so that equal
passages give equal chunks in any document. Each distinct chunk is encoded once and kept for later
texts of the same worker. Where two chunks meet, the join stands if the bytes around it show that the
pre-tokenizer splits there in any text; else both are encoded as one, and where that disagrees they
are merged, until every join agrees. Texts that hold a special token's own text are encoded whole by
the library.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mixed, pieces, ranges, span_hashes, utf8

#: The tokenizer's file; its folder is the installed package of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"
#: One space in so many begins no chunk: chunks are short, as words repeat far more often than lines do.
JOIN_EVERY = 32
#: Chunks that a worker keeps before it begins anew.
KEEP_CHUNKS = 700_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes and decodes texts as the tokenizers library does with this file."""

    def __init__(self, path: str, join_every: int = JOIN_EVERY, keep: int = KEEP_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.fast = _ranks_encoder(path, self.library)
        self.join_every, self.keep = join_every, keep
        self.bytes = _token_bytes(self.library)
        lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.length, self.begin = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.ids, self.sizes = array("I"), array("q")

    def encode_chunk(self, text: str) -> list[int]:
        return self.fast(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Spaces between two bytes that are no ASCII white space, but for those that the rolling hash joins."""
        space = np.flatnonzero(raw == 32)
        space = space[(space > 0) & (space < len(raw) - 1)]
        before, after = raw[space - 1], raw[space + 1]
        space = space[(before > 32) & (after > 32)]
        if self.join_every > 1:
            window = np.zeros(len(space), np.uint64)
            for back in range(8, 0, -1):
                window = window * np.uint64(0x100000001B3) + raw[np.maximum(space - back, 0)]
            space = space[mixed(window) % np.uint64(self.join_every) != 0]
        return space

    @staticmethod
    def _sure(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Cuts whose neighbours are ASCII, or two-byte letters from U+00C0 to U+00FF: no white space,
        so that the pre-tokenizer puts this one space at the head of the next word's token."""
        before, after, lead = raw[cut - 1], raw[cut + 1], raw[np.maximum(cut - 2, 0)]
        return ((before < 127) | (lead == 0xC3)) & ((after < 127) | (after == 0xC3))

    def number(self, chunk: bytes) -> int:
        """The chunk's number; it is encoded if it is new."""
        found = self.known.get(chunk)
        if found is None:
            found = self.known[chunk] = len(self.sizes)
            ids = self.encode_chunk(chunk.decode())
            self.ids.extend(ids)
            self.sizes.append(len(ids))
        return found

    def joins(self, a: bytes, b: bytes) -> bool:
        """Whether both chunks together are encoded as they are apart."""
        return self.encode_chunk((a + b).decode()) == self.encode_chunk(a.decode()) + self.encode_chunk(b.decode())

    def repaired(self, chunks: list[bytes]) -> list[int]:
        """Ids of one text: chunks whose join disagrees are merged until all joins agree."""
        done: list[bytes] = []
        for chunk in chunks:
            while done and not self.joins(done[-1], chunk):
                chunk = done.pop() + chunk
            done.append(chunk)
        return [i for chunk in done for i in self.encode_chunk(chunk.decode())]

    def ids_of(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts joined, and where each text's begin (one more than texts)."""
        if len(self.known) > self.keep:
            self.forget()
        data, texts = raw.tobytes(), np.flatnonzero(np.diff(at))
        cut = self.cuts(raw)
        cut = cut[~np.isin(cut, at)]
        begin = np.concatenate((at[texts], cut))
        begin.sort()
        end = np.append(begin[1:], len(raw))
        _, one, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        chunk = np.array([self.number(data[b:e]) for b, e in zip(begin[one].tolist(), end[one].tolist())], np.int64)[which]
        unsure = np.searchsorted(begin, cut[~self._sure(raw, cut)])
        wrong = set()
        for k in unsure.tolist():
            pair = int(chunk[k - 1]), int(chunk[k])
            if pair not in self.agree:
                self.agree[pair] = self.joins(data[begin[k - 1] : begin[k]], data[begin[k] : end[k]])
            if not self.agree[pair]:
                wrong.add(int(np.searchsorted(at, begin[k], "right")) - 1)
        sizes = np.array(self.sizes, np.int64)
        counts = sizes[chunk]
        ids = np.array(self.ids, np.uint32)[np.repeat((np.cumsum(sizes) - sizes)[chunk], counts) + ranges(counts)]
        first = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(begin, at)]
        return replaced(ids, first, {k: self.repaired([data[b:e] for b, e in zip(begin, end) if at[k] <= b < at[k + 1]]) for k in wrong})

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        counts = self.length[ids]
        data = self.flat[np.repeat(self.begin[ids], counts) + ranges(counts)].tobytes()
        return data.decode("utf-8", "replace").encode()


def _token_bytes(library) -> list[bytes]:
    """The bytes of each id. Byte-level vocabularies write a byte as a printable character: itself
    where it prints, else the next free character from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    names = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
    return [special[i].encode() if i in special else bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]


def _ranks_encoder(path: str, library):
    """The same merges as ranks, which encode faster; none if there is no such file beside the tokenizer's."""
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    except (ImportError, OSError):
        return None
    if any(library.token_to_id(t) is None for t in ("a", "b")) or len(ranks) + len(library.get_added_tokens_decoder()) != library.get_vocab_size(with_added_tokens=True):
        return None
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def replaced(ids: np.ndarray, first: np.ndarray, rows: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and first with the rows of these texts instead of their own."""
    if not rows:
        return ids, first
    each = [np.array(rows[k], np.uint32) if k in rows else ids[a:b] for k, (a, b) in enumerate(zip(first[:-1], first[1:]))]
    return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, join_every: int = JOIN_EVERY) -> ChunkEncoder:
    if (path, join_every) not in _encoders:
        _encoders[path, join_every] = ChunkEncoder(path, join_every)
    return _encoders[path, join_every]


def encoded(coder: ChunkEncoder, column) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow string column, and where each text's begin (one more than texts)."""
    raw, at = utf8(column)
    data = raw.tobytes()
    ids, first = coder.ids_of(raw, at)
    if any(t.encode() in data for t in coder.special):
        whole = {k: coder.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(column.to_pylist()) if t and any(x in t for x in coder.special)}
        ids, first = replaced(ids, first, whole)
    return ids, first


def _digests(batches, path: str):
    coder = encoder(path)
    for part in pieces(batches, "text"):
        ids, first = encoded(coder, part.column(1))
        little = ids.astype("<u4")
        out = [(hashlib.sha256(little[a:b]).hexdigest(), hashlib.sha256(coder.decode(ids[a:b])).hexdigest()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: its number of tokens, and digests of its ids and of their decoded text.

    A null text is empty: no tokens, the digests of nothing. A null or repeated doc_id is carried
    through. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return slim.mapInArrow(partial(_digests, path=path or tokenizer_path()), SCHEMA)


def _encode(batches, path: str):
    coder = encoder(path)
    for part in pieces(batches, "text"):
        ids, first = encoded(coder, part.column(part.schema.get_field_index("text")))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
        at = part.schema.get_field_index("token_ids")
        arrays = [c for k, c in enumerate(part.columns) if k != at]
        names = [n for k, n in enumerate(part.schema.names) if k != at]
        yield pa.RecordBatch.from_arrays([*arrays, lists], names=[*names, "token_ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with `token_ids`; a column of that name is replaced."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name != "token_ids"] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(partial(_encode, path=path or tokenizer_path()), schema)


def _decode(batches, path: str):
    coder = encoder(path)
    for batch in batches:
        at = batch.schema.get_field_index("token_ids")
        texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode() for x in batch.column(at).to_pylist()]
        keep = [k for k, n in enumerate(batch.schema.names) if n not in ("token_ids", "text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*(batch.schema.names[k] for k in keep), "text"])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`text` from `token_ids`, instead of both; null ids give a null text."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("token_ids", "text")] + [T.StructField("text", T.StringType())])
    return rows.mapInArrow(partial(_decode, path=path or tokenizer_path()), schema)
