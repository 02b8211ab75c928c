"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's 64 bits are segments A (23), B (23) and R (18). The perfect Golay code sends a 23-bit word to
codewords: all words within one bit of it decode to one codeword or to six, and two words that differ in at
most two bits share one. Four errors over three segments leave either a segment without error, and then
another with at most two (keys: exact segment and codeword), or at least one error in each, and then at most
two in A and in B (keys: codewords of A and B). Every linked pair therefore shares a key; a key's fingerprints
are verified by their bits. Equal fingerprints are one node, so copies of any number cost one row, and a key
yields a spanning forest of its links, never all pairs.

Null texts are empty; texts without words have fingerprint zero, linked like any other. Null ids take part
and get a component, which is null if no row of it has an id. Repeated rows share a fingerprint. Extra columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, give_back, hidden
from weftline.llm.components import connected_components, stars

SEGMENTS = {"A": (0, 23), "B": (23, 23), "R": (46, 18)}
ERRORS = 4
#: Fingerprints from which the widest keys get six more exact bits: both forms find the same links.
WIDE_FROM = 1 << 24


@lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of the codeword within three bits of it."""
    index = np.arange(4096, dtype=np.uint32)
    words, rest = index << 11, index << 11
    for bit in range(22, 10, -1):  # remainder by x^11+x^9+x^7+x^6+x^5+x+1
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(0xAE3 << (bit - 11)), rest)
    words = words | rest
    bits = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), bits]
    two = [bits[i] | bits[j] for i in range(23) for j in range(i)]
    three = [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.concatenate([*errors, np.array(two, np.uint32), np.array(three, np.uint32)])
    table = np.zeros(1 << 23, np.uint16)
    for e in errors:
        table[words ^ e] = index
    return table


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices within reach of each 23-bit word, and which of them are new in their row."""
    table = golay()
    near = words[:, None] ^ np.append(np.uint32(0), np.uint32(1) << np.arange(23, dtype=np.uint32))
    found = np.sort(table[near], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rank = np.cumsum(new, axis=1) - 1
    out, has = np.zeros((len(words), 6), np.int64), np.zeros((len(words), 6), bool)
    rows, cols = np.nonzero(new)
    out[rows, rank[rows, cols]] = found[rows, cols]
    has[rows, rank[rows, cols]] = True
    return out, has


def keys_of(prints: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint (uint64)."""
    seg = {k: (prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for k, (at, n) in SEGMENTS.items()}
    code = {k: codewords(v.astype(np.uint32)) for k, v in seg.items()}
    rows, keys = [], []

    def add(kind: int, base: np.ndarray, has: np.ndarray) -> None:
        r, c = np.nonzero(has)
        rows.append(r)
        keys.append(base[r, c] | np.int64(kind) << 56)

    for kind, (exact, fuzzy) in enumerate(("RA", "RB", "AB", "BA", "AR", "BR")):
        add(kind, seg[exact][:, None] << 12 | code[fuzzy][0], code[fuzzy][1])
    both = (code["A"][0][:, :, None] << 12 | code["B"][0][:, None, :]).reshape(len(prints), 36)
    has = (code["A"][1][:, :, None] & code["B"][1][:, None, :]).reshape(len(prints), 36)
    if wide:  # R has at most two errors here, so one of its three blocks of six bits has none
        for k in range(3):
            add(6 + k, both << 6 | (seg["R"] >> 6 * k & 63)[:, None], has)
    else:
        add(6, both, has)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    each = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(each), 1 << 14):
        counts += np.unpackbits(each[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(each), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and fp (the fingerprint of text, its 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            prints = np.zeros(batch.num_rows, np.uint64)
            for k in range(0, batch.num_rows, 256):
                for i, value in enumerate(batch.column(len(keys)).slice(k, 256).to_pylist()):
                    prints[k + i] = fingerprint(value)
            yield pa.record_batch([*batch.columns[: len(keys)], pa.array(prints.view(np.int64))], [*keys, "fp"])
        give_back()

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}fp long")


def _linked(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among a key's fingerprints: each visited one scans only those not yet reached."""
    left = np.unique(prints)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= ERRORS
            head = queue.pop()
            if near.any():
                reached = left[near]
                yield np.full(len(reached), head), reached
                queue.extend(reached)
                left = left[~near]


def links(prints: DataFrame, wide: bool = False) -> DataFrame:
    """(u, v) edges between distinct fingerprints (column fp) that connect whatever differs in at most four bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(k, 4096).to_numpy()
                rows, keys = keys_of(own.view(np.uint64), wide)
                yield pa.record_batch([pa.array(keys), pa.array(own[rows])], ["key", "fp"])
            give_back()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def ready() -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*forest, strict=True))
            yield stars(u, v)  # one star a component, however many keys its links share
            forest.clear()

        def check(k: np.ndarray, f: np.ndarray) -> None:
            nonlocal size
            edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            counts = np.diff(np.append(edge, len(k)))
            small = np.repeat(counts <= 16, counts)
            for shift in range(1, min(16, int(counts.max(initial=1)))):
                near = (k[shift:] == k[:-shift]) & small[shift:] & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= ERRORS)
                if near.any():
                    forest.append((f[:-shift][near], f[shift:][near]))
                    size += int(near.sum())
            for at in np.flatnonzero(counts > 16):
                for u, v in _linked(f[edge[at] : edge[at] + counts[at]]):
                    forest.append((u, v))
                    size += len(u)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            own = np.concatenate([own, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last:
                check(keys[:last], own[:last])
                keys, own = keys[last:], own[last:]
            if size > 1 << 20:
                yield from ready()
                size = 0
        if len(keys):
            check(keys, own)
        if forest:
            yield from ready()

    pairs = prints.select("fp").mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return pairs.mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys (doc_id among them), fp, component_id for each row of docs: the least doc_id that a chain of links reaches."""
    each = cut(fingerprints(docs, keys))
    nodes = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")), 16)
    found = connected_components(links(nodes, nodes.count() > WIDE_FROM))
    named = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "component").select("fp", "component_id"), 16)
    return each.join(named, "fp").select(*keys, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that their component is named after, each once. Rows without an id can't be named and stay.

    The rows to keep are chosen by id, hash of the text and, of repeated rows, number; the texts move once.
    """
    own = hidden(docs, "doc_id", "text").withColumns({"_th": F.xxhash64(F.coalesce("text", F.lit("")))})
    found = near_duplicates(own.where("doc_id is not null"), ("doc_id", "_th")).where("doc_id = component_id").select("doc_id", "_th").distinct()
    named = own.where("doc_id is not null").join(found, ["doc_id", "_th"], "left_semi")
    # equal keys are in one task after the join: dropping repeats shuffles nothing
    kept = named.dropDuplicates(["doc_id", "_th"])
    return kept.unionByName(own.where("doc_id is null")).drop("_th").toDF(*docs.columns)
