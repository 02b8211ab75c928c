"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each leaf holds the rank of the pair that begins at a live byte position, each inner node the least
(rank, position) below it, so the root is the leftmost pair of least rank. A merge updates the leaves of the
merged position, the one absorbed and the live left neighbour, and their ancestors. Short pieces run through
many trees at once (numpy, one row per piece); long ones through one tree of Python lists, O(n log n).

Texts may be null (as empty), empty or of any length; ids never cross pieces of the pre-tokenizer. Rows are
independent: repeated rows and extra columns need no rule, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.chunk_cache import ChunkCache

_NONE = np.int32(2**31 - 1)
_SHIFT, _MASK = 8, 255  # of a leaf: rank above position; pieces in numpy trees have at most 256 bytes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SegmentTreeBPE:
    """Encodes distinct pieces of bytes by merge ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0).astype(np.int32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit bytes. A piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > 256:
                out[i] = self._one(piece)
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, members in by_size.items():
            step = max(1, (1 << 17) // size)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self._many([pieces[i] for i in some], size), strict=True):
                    out[i] = ids
        return out

    def _pair_leaves(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at] << _SHIFT | pos.astype(np.int32), _NONE)

    def _many(self, pieces: list[bytes], size: int) -> Iterator[bytes]:
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        at = np.arange(size)
        tok = np.zeros((n, size + 1), np.int64)
        tok[:, :size] = self.byte_ids[raw]
        live = np.zeros((n, size + 1), bool)
        live[:, :size] = at < lengths[:, None]
        after = np.minimum(np.tile(np.append(at + 1, size), (n, 1)), size)
        after = np.where(after < lengths[:, None], after, size)  # size: nothing follows
        before = np.tile(np.append(at - 1, size), (n, 1))  # -1: nothing precedes
        tree = np.full((n, 2 * size), _NONE, np.int32)
        rows, cols = np.nonzero(live[:, : size - 1] & live[:, 1:size])
        tree[rows, size + cols] = self._pair_leaves(tok[rows, cols], tok[rows, cols + 1], cols)
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            going = root != _NONE
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            pos = (root & _MASK).astype(np.int64)
            gone = after[rows, pos]
            follow = after[rows, gone]
            tok[rows, pos] = root >> _SHIFT
            live[rows, gone] = False
            after[rows, pos] = follow
            before[rows, follow] = pos  # column size takes the writes of pieces that end here
            lead = before[rows, pos]
            tree[rows, size + gone] = _NONE
            tree[rows, size + pos] = np.where(follow < size, self._pair_leaves(tok[rows, pos], tok[rows, follow], pos), _NONE)
            led = lead >= 0
            r, p = rows[led], lead[led]
            tree[r, size + p] = self._pair_leaves(tok[r, p], tok[r, pos[led]], p)
            a, b, c = (size + pos) >> 1, (size + gone) >> 1, (size + p) >> 1
            while a[0]:
                for some, node in ((rows, a), (rows, b), (r, c)):
                    tree[some, node] = np.minimum(tree[some, 2 * node], tree[some, 2 * node + 1])
                a, b, c = a >> 1, b >> 1, c >> 1
        flat = tok[:, :size][live[:, :size]].astype("<u4")
        ends = 4 * np.cumsum(live[:, :size].sum(1))
        data, start = flat.tobytes(), 0
        for end in ends.tolist():
            yield data[start:end]
            start = end

    def _one(self, piece: bytes) -> bytes:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none = 1 << 60
        tok = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: (r << 32 | i) if (r := self.pairs.get(tok[i] << 32 | tok[j])) is not None else none
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best
                k >>= 1

        alive = bytearray(b"\1") * n
        while tree[1] != none:
            pos, merged = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[pos]
            follow = after[gone]
            tok[pos], alive[gone], after[pos] = merged, 0, follow
            put(gone, none)
            if follow < n:
                before[follow] = pos
                put(pos, rank(pos, follow))
            else:
                put(pos, none)
            if before[pos] >= 0:
                put(before[pos], rank(before[pos], pos))
        return np.array([t for t, a in zip(tok, alive, strict=True) if a], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class TextEncoder:
    """Whole texts to ids: pre-tokenizer, chunk and piece caches, segment trees."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 400_000):
        self.bpe, self._split, self._pieces, self._max = SegmentTreeBPE(ranks), regex.compile(pattern).findall, {}, max_pieces
        self._chunks = ChunkCache(self._encode_chunks, pattern)

    def _encode_chunks(self, chunks: list[str]) -> Iterator[bytes]:
        split = [self._cut(chunk) for chunk in chunks]
        new = list(set().union(*split).difference(self._pieces)) if split else []
        if len(self._pieces) + len(new) > self._max:
            self._pieces.clear()
            new = list(set().union(*split))
        self._pieces.update(zip(new, self.bpe.encode([p.encode() for p in new]), strict=True))
        get = self._pieces.__getitem__
        return (b"".join(map(get, pieces)) for pieces in split)

    def _cut(self, chunk: str) -> list[str]:
        """The pre-tokenizer's pieces; without its pattern for a word of letters alone or before one full stop or comma."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return [chunk]
        return [chunk[:-1], chunk[-1]] if word[-1:] in (".", ",") and word[:-1].isalpha() else self._split(chunk)

    def encode(self, texts) -> Iterator[bytes]:
        return self._chunks.encode(texts)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One per Python worker; later tasks of the worker find its caches filled."""
    return TextEncoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit), decoded (binary): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(ranks_path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = list(codec.encode(part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.bpe.decode, ids), pa.binary())], ["k", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ids binary, decoded binary").withColumnRenamed("k", key)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the digests are taken where the ids are made, so none are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(ranks_path, pattern)
        for batch in batches:
            ns, hashes, plain = [], [], []
            for k in range(0, batch.num_rows, 512):
                for ids in codec.encode(batch.column(1).slice(k, 512).to_pylist()):
                    ns.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    plain.append(hashlib.sha256(codec.bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
