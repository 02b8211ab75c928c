"""Repeated-window removal by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered only through `window` bytes, digit by digit, and groups that can no longer repeat leave after
each digit; the groups left equal after the last one are exactly the windows that occur in more than one document.
Inside a task, `ranks` does this on eight bytes at a time. Between tasks there are three passes, of ever fewer suffixes:

1. Of the suffixes, those at anchors go first: a window's anchor is, of its stretches of `gram` bytes, the leftmost
   of least hash, so equal windows have equal anchors and all windows around one anchor are a run (start, count),
   about one for every (window - gram) / 2 bytes. Their first digit is the anchor's stretch. A block of documents
   sends its distinct first digits and hears which of them another block or document has. Digits are dealt by hash,
   which here can only let a suffix live that does not repeat.
2. The rest of a run's text is its second digit. Runs that are equal byte by byte repeat wholly: all but those of the
   least document are covered. This settles the inside of any repeated passage.
3. Runs whose first digit has several second digits, and whose text beside it on one side is shared too, are the
   edges of passages. They are taken apart into windows, which are dealt each by itself and compared byte by byte.

Documents are dealt once into blocks of a few megabytes, stored on shared storage and dealt by shelves, of a few
blocks each; afterwards only digits and spans move. A block settles its own repeats and sends one record for a group,
that of its least document, so a group of any number of copies has a record a block at most and no bucket holds more
of a hot passage than that. Buckets, hashes' leading bits, grow in number with the input and keep their size. What
blocks and buckets say goes in one row from several blocks to a bucket and from a bucket to a shelf, as rows between
every block and every bucket would grow with the input's square.

Texts are UTF-8 bytes, null texts empty. Rows without an id are neither changed nor a source. Rows with one id
don't cover each other. Extra columns are kept by remove_repeats and ignored by the digest. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, give_back

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 2 << 20
#: Bits of a block's number within its shelf.
SHELF = 1
#: Blocks of a task whose records go to the buckets together.
TOGETHER = 4
#: Executors read and pass on a block or so at a time: batches of all a task's rows are held several times over, and arrays
#: as large make the JVM's heap grow for good.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK), "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: Places that are looked at together: their hashes stay in the processor's cache.
STRIP = 1 << 15
#: Records of a bucket, about so many, whose texts are compared at once.
PART = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Block:
    """Concatenated texts with hashes of any stretch."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.append(0, np.cumsum(self.sizes)[:-1]) if len(texts) else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self._data = data
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(data), STRIP):
            part = _BYTE[data[a : a + STRIP]]
            part *= up[a : a + len(part)]
            part[:1] += self._sums[a : a + 1]
            np.cumsum(part, out=self._sums[a + 1 : a + 1 + len(part)])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sums[end] - self._sums[start]) * self._down[start])

    def text(self, start: np.ndarray, size: np.ndarray | int, width: int) -> np.ndarray:
        """(n, width) bytes of stretches, zero beyond their sizes."""
        padded = np.concatenate([self._data, np.zeros(width, np.uint8)])
        found = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
        if not isinstance(size, int):
            found[np.arange(width) >= size[:, None]] = 0
        return found

    def runs(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """first digit, document (index), first window, windows, place of the minimizer: of each run."""
        n, width = len(self._sums) - 1, window - gram + 1
        none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
        if n < window:
            return none
        # the place fills the low bits, so the least value is the leftmost of the least hash
        bits = np.uint64(max(1, int(n).bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        ends = self.starts + self.sizes
        inside = np.ones(n - window + 1, bool)
        for e in ends.tolist():
            inside[max(0, e - window + 1) : e] = False
        parts, before, open_ = [], -1, False
        for a in range(0, len(inside), STRIP):
            b = min(a + STRIP, len(inside))
            whole = self._sums[a + gram : b + window] - self._sums[a : b + width - 1]
            whole *= self._down[a : b + width - 1]
            whole = _mix(whole)
            best = whole & ~mask
            best |= np.arange(a, b + width - 1, dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                best = np.minimum(best[:-span], best[span:])
                span *= 2
            if span < width:
                best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
            best &= mask
            at, own = best.astype(np.int64), inside[a:b]
            turn = np.ones(b - a, bool)
            turn[1:] = (at[1:] != at[:-1]) | ~own[:-1]
            turn[0] = at[0] != before or not open_
            turn &= own
            before, open_ = int(at[-1]), bool(own[-1])
            first = np.flatnonzero(turn)
            parts.append((whole[at[first] - a], first + a, at[first]))
        k, first, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(first):
            return none
        # of texts that begin at one place, all but the last are empty
        doc = np.searchsorted(self.starts, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(inside)), ends[doc] - window + 1)
        return k, doc, first, last - first, at


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (sorted by document, start) with those that touch or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    reach = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


DIGIT = np.dtype([("b", "<i8"), ("k", "<u8")])
EDGE = np.dtype([("b", "<i8"), ("k", "<u8"), ("s", "<u8")])
SUFFIX = [("b", "<i8"), ("doc", "<i8"), ("i", "<u4"), ("start", "<u4"), ("n", "<u2")]
SPAN = np.dtype([("b", "<i8"), ("i", "<u4"), ("start", "<u4"), ("end", "<u4")])
#: What shelves hear; the field b of any record is its block.
HEARD = {"digit": DIGIT, "open": DIGIT, "span": SPAN}
_ROWS = "bucket long, shelf long, kind string, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, k, kind, data = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.record_batch([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(kind, pa.string()), pa.array(data, pa.binary())], ["bucket", "shelf", "kind", "data"])


def _records(kind: np.dtype, **cols: np.ndarray | int) -> np.ndarray:
    out = np.zeros(max(len(c) for c in cols.values() if np.ndim(c)), kind)
    for name, values in cols.items():
        out[name] = values
    return out


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each stretch of equal values."""
    if not len(sorted_values):
        return []
    edge = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])).tolist()
    return list(zip(edge, [*edge[1:], len(sorted_values)], strict=True))


def _dealt(records: np.ndarray, by: np.ndarray, bits: int, kind: str) -> list[tuple]:
    """Compressed rows of records for the buckets of the leading bits of `by`; within one, as they came."""
    bucket = (by >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    return [(int(bucket[a]), 0, kind, _packed(records[a:b])) for a, b in _cuts(bucket)]


_CODEC = pa.Codec("zstd", compression_level=3)


def _packed(records: np.ndarray) -> bytes:
    """4 bytes of count, then fields one after another, of numbers byte by byte: like stands beside like for the compression."""
    parts = [np.ascontiguousarray(records[f]) for f in records.dtype.names]
    plain = b"".join((x if x.ndim > 1 else x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts)
    return len(records).to_bytes(4, "little") + _CODEC.compress(plain, asbytes=True)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(memoryview(data)[:4], "little")
    plain, at = np.frombuffer(_CODEC.decompress(memoryview(data)[4:], n * kind.itemsize, asbytes=True), np.uint8), 0
    out = np.zeros(n, kind)
    for f in kind.names:
        own = plain[at : at + n * kind[f].itemsize]
        out[f] = own.reshape(n, -1) if kind[f].shape else np.ascontiguousarray(own.reshape(-1, n).T).view(kind[f]).ravel() if n else 0
        at += n * kind[f].itemsize
    return out


def _returned(records: np.ndarray, kind: str) -> list[tuple]:
    """Rows of records for the shelves of their blocks."""
    records = records[np.argsort(records["b"], kind="stable")]
    shelf = records["b"] >> SHELF
    return [(0, int(shelf[a]), kind, _packed(records[a:b])) for a, b in _cuts(shelf)]


def _own(number: int, spans: np.ndarray) -> list[tuple]:
    """The row of spans that a block has found by itself: through no bucket."""
    return [(-1 - (number >> SHELF) % 997, number >> SHELF, "span", _packed(spans))] if len(spans) else []


def blocks_of(docs: DataFrame, bytes_a_block: int = BLOCK) -> DataFrame:
    """(block, shelf, payload): rows of docs, about bytes_a_block of text each, as compressed Arrow; dealt by shelf and stored."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
        waiting: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(waiting).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as out:
                out.write_table(whole)
            number, size = number + 1, 0
            waiting.clear()
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([number >> SHELF], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "shelf", "payload"])

        for batch in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                base = int(sizes[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(sizes, base + bytes_a_block - size)) + 1)
                waiting.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - base
                at = to
                if size >= bytes_a_block:
                    yield flush()
        if waiting:
            yield flush()

    found = docs.select(*columns).mapInArrow(run, "block long, shelf long, payload binary")
    return cut(found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shelf"), settings=SMALL)


def _opened(payload: bytes) -> tuple[pa.Table, Block, np.ndarray, np.ndarray]:
    """The block's table, its texts, their ids (0 if null) and which have one."""
    rows = pa.ipc.open_stream(payload).read_all()
    ids = rows.column("doc_id")
    return rows, Block([(t or "").encode() for t in rows.column("text").to_pylist()]), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()


def _by_bucket(rows: DataFrame, settle: Callable[[list[tuple[int, str, pa.Buffer]]], list[tuple]]) -> DataFrame:
    """settle gets each bucket's (shelf, kind, data) and gives rows for shelves. Buckets below zero pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for bucket, shelf, kind, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if bucket < 0:
                    yield _rows([(0, shelf, kind, data.as_py())])
                    continue
                if bucket != now:
                    if own:
                        yield _rows(settle(own))
                    now, own = bucket, []
                own.append((shelf, kind, data.as_buffer()))
        if own:
            yield _rows(settle(own))
        own.clear()
        give_back()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROWS)


def _gathered(rows: list[tuple[int, str, pa.Buffer]], of: str, kind: np.dtype) -> np.ndarray:
    rows = [data for _, name, data in rows if name == of]
    sizes = [int.from_bytes(memoryview(data)[:4], "little") for data in rows]
    out, at = np.zeros(sum(sizes), kind), 0
    for data, n in zip(rows, sizes, strict=True):
        out[at : at + n] = _unpacked(data, kind)
        at += n
    return out


Heard = Callable[[str], np.ndarray]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, Heard]]:
    """Each block's number, payload and what it is told of a kind; a shelf's messages are opened once while its blocks follow each other."""
    shelf, mail = None, {}
    for batch in batches:
        told = batch.column(2) if batch.num_columns > 2 else None
        for row in range(batch.num_rows):
            number = batch.column(0)[row].as_py()
            if told is not None and number >> SHELF != shelf:
                shelf, mail = number >> SHELF, {}
                for message in told[row].as_py() or ():
                    mail.setdefault(message["kind"], []).append(_unpacked(message["data"], HEARD[message["kind"]]))
                for kind, parts in mail.items():
                    whole = np.concatenate(parts)
                    mail[kind] = whole[np.argsort(whole["b"], kind="stable")]

            def heard(kind: str, number: int = number, mail: dict = mail) -> np.ndarray:
                own = mail.get(kind, np.zeros(0, HEARD[kind]))
                return own[slice(*np.searchsorted(own["b"], [number, number + 1]))]

            yield number, batch.column(1)[row].as_py(), heard


Dealt = dict[str, tuple[np.ndarray, np.ndarray]]


def _block_by_block(blocks: DataFrame, one: Callable[[int, bytes, Heard], tuple[Dealt, list[tuple]]], bits: int) -> DataFrame:
    """What one(number, payload, told) gives for each block: records by kind with what deals them to buckets, and rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Dealt] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in sorted(set().union(*waiting)):
                records, by = (np.concatenate([w[kind][k] for w in waiting if kind in w]) for k in range(2))
                for w in waiting:
                    w.pop(kind, None)
                yield _rows(_dealt(records, by, bits, kind))
            waiting.clear()

        for row in _each(batches):
            dealt, rows = one(*row)
            waiting.append(dealt)
            if rows:
                yield _rows(rows)
            if len(waiting) == TOGETHER:
                yield from flush()
                give_back()
            del row, dealt, rows
        yield from flush()
        give_back()

    return blocks.mapInArrow(run, _ROWS)


def _told(blocks: DataFrame, messages: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with what their shelf is told; only the messages move."""
    heard = messages.groupBy("shelf").agg(F.collect_list(F.struct("kind", "data")).alias("told"))
    return blocks.join(heard, "shelf", how).select("block", "payload", "told")


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before them in any of the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _low(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The least id among the rows of the same keys."""
    order = np.lexsort((ids, *reversed(keys)))
    new = _first(*(k[order] for k in keys))
    out = np.empty_like(ids)
    out[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    return out


def ranks(text: np.ndarray) -> np.ndarray:
    """The place of each row of bytes in their order, equal rows sharing the first one's.

    Most significant digit first, eight bytes a digit; rows that are alone in their group leave.
    """
    n, width = text.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = text
    digits = wide.view(">u8").astype(np.uint64)
    place, live = np.zeros(n, np.int64), np.arange(n)
    for digit in digits.T:
        if not len(live):
            break
        at = live[np.lexsort((digit[live], place[live]))]
        here = np.arange(len(at))
        before, new = _first(place[at]), _first(place[at], digit[at])
        since = lambda mark: np.maximum.accumulate(np.where(mark, here, 0))  # noqa: B023, E731
        place[at] += since(new) - since(before)
        alone = new & np.append(new[1:], True)
        live = at[~alone]
    return place


def _covered(records: np.ndarray) -> np.ndarray:
    """The records whose text (and number of windows) one of a smaller document has too, compared part by part of their first bytes."""
    head = _mix(np.ascontiguousarray(records["t"][:, :8]).view(np.uint64).ravel())
    part = (head % np.uint64(len(records) // PART + 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    over = np.zeros(len(records), bool)
    for a, b in _cuts(part[order]):
        own = order[a:b]
        texts = np.column_stack([records["t"][own], records["n"][own].astype(np.uint8)])  # texts may end in zeros
        over[own] = _low(records["doc"][own], ranks(texts)) != records["doc"][own]
    return records[over]


def _runs(block: Block, has: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    found = block.runs(window, gram)
    some = has[found[1]]
    return tuple(x[some] for x in found)


def _spans(number: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    d, a, b = _joined(doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    return _records(SPAN, b=number, i=d, start=a, end=b)


def repeated_spans(blocks: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """(shelf, kind, data) messages: SPAN records, the byte ranges covered by windows of a smaller document."""
    bits = max(6, max(1, blocks.count()).bit_length() - 4)  # some ten blocks' worth of digits a bucket
    half = (window - gram + 1) // 2
    width = 2 * window - gram  # of the longest run: as many windows as can have one anchor
    run_of, window_of = (np.dtype([("t", "u1", (w,)), *SUFFIX]) for w in (width, window))

    def digits(number: int, payload: bytes, _: Heard) -> tuple[Dealt, list[tuple]]:
        _, block, _, has = _opened(payload)
        k, doc, *_ = _runs(block, has, window, gram)
        order = np.argsort(k, kind="stable")  # runs come by document
        k, doc = k[order], doc[order]
        at = np.flatnonzero(_first(k))
        if not len(at):
            return {}, []
        last = doc[np.append(at[1:], len(k)) - 1]
        # the lowest bit says that two documents of the block have it
        own = _records(DIGIT, b=number, k=k[at] & ~np.uint64(1) | (last != doc[at]))
        # an anchor's hash is the least of many, so its own leading bits are mostly zero
        return {"digit": (own, _mix(k[at] & ~np.uint64(1)))}, []

    def share(rows: list[tuple]) -> list[tuple]:
        got = _gathered(rows, "digit", DIGIT)
        got = got[np.argsort(got["k"], kind="stable")]
        k, many = got["k"] & ~np.uint64(1), (got["k"] & np.uint64(1)).astype(bool)
        group = np.cumsum(_first(k)) - 1
        keep = ((np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0))[group]
        return _returned(_records(DIGIT, b=got["b"][keep], k=k[keep]), "digit")

    shared = cut(_by_bucket(_block_by_block(blocks.select("block", "payload"), digits, bits), share), 4, SMALL)

    def sides(block: Block, k: np.ndarray, doc: np.ndarray, at: np.ndarray, name: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the anchor with the text before it, and after it: equal where the texts are, of one run (by its name) where the document ends."""
        alone = _mix(name.astype(np.uint64) ^ np.uint64(number) << np.uint64(32))
        start, end = block.starts[doc], (block.starts + block.sizes)[doc]
        left = np.where(at - start >= half, block.hashes(np.maximum(at - half, 0), at), alone)
        right = np.where(at + gram + half <= end, block.hashes(np.minimum(at + gram, end), np.minimum(at + gram + half, end)), ~alone)
        return _mix(left ^ k) & ~np.uint64(1), _mix(right + k) & ~np.uint64(1)

    def stretches(number: int, payload: bytes, told: Heard) -> tuple[Dealt, list[tuple]]:
        _, block, ids, has = _opened(payload)
        k, doc, first, many, at = _runs(block, has, window, gram)
        name = np.flatnonzero(np.isin(k & ~np.uint64(1), told("digit")["k"]))
        if not len(name):
            return {}, []
        k, doc, first, many, at = (x[name] for x in (k, doc, first, many, at))
        left, right = sides(block, k, doc, at, name, number)
        text = block.text(first, many + window - 1, width)
        place = ranks(np.column_stack([text, many.astype(np.uint8)]))  # texts may end in zeros
        low = _low(ids[doc], place) == ids[doc]
        start = first - block.starts[doc]
        end = start + many + window - 1
        rows = _own(number, _records(SPAN, b=number, i=doc[~low], start=start[~low], end=end[~low]))
        s = block.hashes(first, first + many + window - 1)
        order = np.flatnonzero(low)[np.argsort(place[low], kind="stable")]
        dealt = {"run": (_records(run_of, b=number, t=text[order], doc=ids[doc[order]], i=doc[order], start=start[order], n=many[order]), s[order])}
        # one row an edge: its second digit, and in the lowest bit of its key whether the block has several
        edge, of = np.concatenate([left[low], right[low]]), np.concatenate([s[low], s[low]])
        order = np.lexsort((of, edge))
        edge, of = edge[order], of[order]
        begin = np.flatnonzero(_first(edge))
        several = of[np.append(begin[1:], len(of)) - 1] != of[begin]
        dealt["edge"] = _records(EDGE, b=number, k=edge[begin] | several, s=of[begin]), edge[begin]
        return dealt, rows

    def sort_runs(rows: list[tuple]) -> list[tuple]:
        r = _covered(_gathered(rows, "run", run_of))
        found = _returned(_records(SPAN, b=r["b"], i=r["i"], start=r["start"], end=r["start"] + r["n"] + (window - 1)), "span")
        r = _gathered(rows, "edge", EDGE)
        if not len(r):
            return found
        k = r["k"] & ~np.uint64(1)
        order = np.lexsort((r["s"], k))
        k, s, several = k[order], r["s"][order], (r["k"][order] & np.uint64(1)).astype(bool)
        new = _first(k)
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.append(begin[1:], len(k)) - 1
        open_ = ((s[begin] != s[last]) | (np.bincount(group, weights=several) > 0))[group]
        return found + _returned(_records(DIGIT, b=r["b"][order][open_], k=k[open_]), "open")

    second = cut(_by_bucket(_block_by_block(_told(blocks, shared), stretches, bits), sort_runs), settings=SMALL)

    def apart(number: int, payload: bytes, told: Heard) -> tuple[Dealt, list[tuple]]:
        open_, done = told("open")["k"], told("span")
        if not len(open_):
            return {}, []
        _, block, ids, has = _opened(payload)
        k, doc, first, many, at = _runs(block, has, window, gram)
        left, right = sides(block, k, doc, at, np.arange(len(k)), number)
        # runs that an equal one of a smaller document covers are done
        name = doc << 32 | first - block.starts[doc]
        left, right = np.isin(left, open_), np.isin(right, open_)
        edge = (left | right) & ~np.isin(name, done["i"].astype(np.int64) << 32 | done["start"])
        doc, first, many, at, left, right = (x[edge] for x in (doc, first, many, at, left, right))
        row = np.repeat(np.arange(len(doc)), many)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        # a window that holds a whole side can't repeat unless that side is shared
        before = at[row] - start
        some = (left[row] | (before < half)) & (right[row] | (window - gram - before < half))
        start, doc = start[some], doc[row][some]
        text = block.text(start, window, window)
        place = ranks(text)
        low = _low(ids[doc], place) == ids[doc]
        at = start - block.starts[doc]
        rows = _own(number, _spans(number, doc[~low], at[~low], at[~low] + window))
        order = np.flatnonzero(low)[np.argsort(place[low], kind="stable")]
        records = _records(window_of, b=number, t=text[order], doc=ids[doc[order]], i=doc[order], start=at[order])
        return {"window": (records, block.hashes(start[order], start[order] + window))}, rows

    def sort_windows(rows: list[tuple]) -> list[tuple]:
        r = _covered(_gathered(rows, "window", window_of))
        return _returned(_records(SPAN, b=r["b"], i=r["i"], start=r["start"], end=r["start"] + window), "span")

    third = cut(_by_bucket(_block_by_block(_told(blocks, second), apart, bits), sort_windows), 2, SMALL)
    return second.where("kind = 'span'").union(third).select("shelf", "kind", "data")


def _kept(told: Heard, texts: Block, rows: pa.Table) -> Iterator[tuple[bytes, int, bytes]]:
    """Of each row: the text's bytes, how many maximal runs are removed, what is kept."""
    got = told("span")
    spans = _spans(0, got["i"], got["start"], got["end"])
    of = np.split(spans, np.searchsorted(spans["i"], np.arange(1, len(texts.sizes)))) if len(texts.sizes) else []
    for text, own in zip(rows.column("text").to_pylist(), of, strict=True):
        data = (text or "").encode()
        kept, at = [], 0
        for a, b in zip(own["start"].tolist(), own["end"].tolist(), strict=True):
            kept.append(data[at:a])
            at = b
        yield data, len(own), b"".join(kept) + data[at:]


def digest_documents(docs: DataFrame, window: int = 50, bytes_a_block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    blocks = blocks_of(docs.select("doc_id", "text"), bytes_a_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload, told in _each(batches):
            rows, texts, *_ = _opened(payload)
            found = [(len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()) for data, n, kept in _kept(told, texts, rows)]
            cols = list(zip(*found, strict=True)) or [()] * 4
            ids = rows.column("doc_id").combine_chunks()
            yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _told(blocks, repeated_spans(blocks, window), "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with repeated windows taken out of text, n_chars following. Left-over bytes of a character cut in two go too."""
    blocks = blocks_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload, told in _each(batches):
            rows, texts, *_ = _opened(payload)
            new = [kept.decode(errors="ignore") if n else text for text, (_, n, kept) in zip(rows.column("text").to_pylist(), _kept(told, texts, rows), strict=True)]
            rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            yield from rows.combine_chunks().to_batches()

    out = _told(blocks, repeated_spans(blocks, window), "left").mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
