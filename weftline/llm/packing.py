"""Best-fit packing: a configuration LP over the length histogram, rounded.

Lengths are at most `size`, so the histogram has at most `size` entries whatever the corpus; only it reaches
the driver. A configuration says how many pieces of each length share a sequence. The covering LP (fewest
sequences such that every piece has a place) is solved by multiplicative weights: lengths begin with their share
of a sequence as price; each round a knapsack dynamic program finds the dearest configuration through every
length, those that are as dear as any are used, and the price of a length falls exponentially with the part of
its pieces that is covered. Prices over the dearest configuration are a solution of the dual, whose value is a
lower bound that no packing can pass. Amounts are rounded down, the LP is solved again for what is left while
that places pieces, and the last pieces (few, whatever the corpus: amounts below one) are best fits: the longest
piece left with the fullest completion that the pieces left allow. The plan is a table of ranges of ranks: pieces
of one length are numbered by partition, and each finds its sequence and offset by its number, so no piece moves
to be packed.

Null texts are empty; an empty document is its end token alone. Added tokens of the vocabulary are found in texts
as the tokenizers library finds them. Repeated rows and tied lengths get places of their own. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, give_back

log = logging.getLogger(__name__)


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids of a byte-level BPE file of the tokenizers library, whose ids rise in the order of merges; its added tokens to ids."""
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], whole.get("added_tokens") or []
    if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"added tokens of {vocabulary} take what stands beside them")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ids = {bytes(char[c] for c in token): i for token, i in model["vocab"].items() if all(c in char for c in token)}
    order = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if order != sorted(order):
        raise ValueError(f"ids of {vocabulary} don't follow its merges")
    special = {t["content"]: t["id"] for t in added}
    for content in special:
        ids.pop(content.encode(), None)
    return ids, special


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit bytes."""
    ranks, special = ranks_of(vocabulary)
    one = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(text: str) -> bytes:
        if marks is None or not marks.search(text):
            return np.array(one(text), "<u4").tobytes()
        ids: list[int] = []
        for k, part in enumerate(marks.split(text)):  # every other part is an added token
            ids += [special[part]] if k % 2 else one(part)
        return np.array(ids, "<u4").tobytes()

    return encode


def pieces_of(docs: DataFrame, vocabulary: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, local): the piece's number among its length in its task.

    The first piece takes what doesn't fill `size`, the others are full. Cut the lineage before use: part is the task's.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary, pattern), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            give_back()
            rows: list[tuple] = []
            texts = (t for k in range(0, batch.num_rows, 256) for t in batch.column(1).slice(k, 256).to_pylist())
            for i, text in enumerate(texts):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % size or size
                for piece, (a, b) in enumerate(zip([0, *range(first, n, size)], range(first, n + 1, size), strict=True)):
                    rows.append((i, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                    seen[b - a] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)), *(pa.array(cols[:, c]) for c in (2, 3, 4, 5)), pa.array(np.full(len(cols), part))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"],
            )
            del rows, cols
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, local long, part long")


def knapsack(price: np.ndarray, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The dearest filling's price; take[room]: the length put last into the dearest filling of room (0: none); down[room]: largest room that uses it."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    back = price[1:]
    for room in range(1, size + 1):
        value = back[:room] + best[room - 1 :: -1][:room]
        k = room - 1 - int(value[::-1].argmax())  # of equal fillings that with the longest piece: short ones last longer
        if value[k] > best[room - 1]:
            best[room], take[room] = value[k], k + 1
        else:
            best[room] = best[room - 1]
    return float(best[size]), take, np.maximum.accumulate(np.where(take > 0, np.arange(size + 1), 0))


def completions(take: np.ndarray, down: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """For each length in firsts, counts by length of that length and the dearest filling of the room beside it."""
    counts = np.zeros((len(firsts), size + 1), np.int64)
    row = np.arange(len(firsts))
    counts[row, firsts] = 1
    room = down[size - firsts]
    while room.any():
        some = room > 0
        length = take[room[some]]
        counts[row[some], length] += 1
        room[some] = down[room[some] - length]
    return counts


@dataclass
class Solution:
    """Of the covering LP: configurations and their amounts; a value of the dual, which no packing can pass."""

    found: dict[bytes, float]
    value: float
    bound: float

    def configurations(self) -> list[tuple[np.ndarray, float]]:
        return [(np.frombuffer(k, np.int64), x) for k, x in sorted(self.found.items(), key=lambda f: (-f[1], f[0]))]


def prices(histogram: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, float]:
    """Dual prices of the lengths by multiplicative weights, and their value.

    Lengths begin with their share of a sequence or the step function of it that is worth most: long pieces can't
    share, so theirs is a whole sequence and that of what fits beside them nothing. A round covers a share of the pieces by the dearest configurations
    through each length, longest first; the price of a length falls exponentially with how often it is covered.
    """
    lengths, some = np.arange(size + 1), histogram > 0
    need, firsts = np.maximum(histogram, 1), np.flatnonzero(some)[::-1]
    starts = [lengths / size, *(np.floor((k + 1) * lengths / (size + 1)) / k for k in range(1, 7))]
    starts += [np.where(lengths > size - e, 1.0, np.where(lengths < e, 0.0, lengths / size)) for e in range(size // 16, size // 2 + 1, max(1, size // 16))]
    start = max((np.where(some, y, 0.0) for y in starts), key=lambda y: float(histogram @ y) / max(1.0, knapsack(y, size)[0]))
    price, cover, best, bound = start, np.zeros(size + 1), start, 0.0
    for turn in range(1, rounds + 1):
        dearest, take, down = knapsack(price, size)
        value = float(histogram @ price) / dearest
        if value > bound:
            best, bound = price / dearest, value
        own = np.zeros(size + 1)
        for first, counts in zip(firsts.tolist(), completions(take, down, firsts, size), strict=True):
            if own[first] < histogram[first]:
                own += counts * ((histogram[first] - own[first]) / counts[first])
        cover += own / need
        excess = cover / turn  # as an average: at least 1
        price = np.where(some, start * np.exp(-0.5 * (1 - turn / rounds / 2) * np.minimum(excess - 1, 3)), 0.0)
        start = price if turn % 4 == 0 else start
    return best, bound


def fractional(histogram: np.ndarray, size: int, rounds: int, slack: float) -> Solution:
    """The covering LP's amounts by multiplicative weights around its dual prices, as far as tight configurations go.

    A round moves the cover of a length by at most a `rounds`th of its pieces, by configurations within `slack` of
    the dearest: no better solution uses others. Weights fall with the part that is covered, so lengths are covered
    evenly and none too often.
    """
    price, bound = prices(histogram, size, rounds)
    need, left, found = np.maximum(histogram, 1).astype(float), histogram.astype(float), {}
    lead, turns = True, 0  # pieces that can't share with another such need a sequence each: they take their fillings first
    while (left > 1e-9 * need).any():
        some = left > 1e-9 * need
        firsts = np.flatnonzero(some)[::-1]
        # among tight ones those of few pieces: short pieces are what the last gaps can take
        weight = price * np.exp(-slack / 2 * (1 - left / need)) + slack * (np.arange(size + 1) / size - 0.25)
        _, take, down = knapsack(np.where(some, np.maximum(weight, 1e-9), 0.0), size)
        firsts = firsts[firsts > size // 2] if lead else firsts
        counts = completions(take, down, firsts, size)
        room, before = np.minimum(left, need / rounds), left.sum()
        for c in counts[counts @ price >= 1 - slack]:
            used = np.flatnonzero(c)
            step = float((room[used] / c[used]).min())
            if step > 0:
                room[used] -= step * c[used]
                left[used] -= step * c[used]
                found[c.tobytes()] = found.get(c.tobytes(), 0.0) + step
        turns += 1
        if left.sum() >= before or turns == (2 if lead else 8) * rounds:
            if not lead:
                break
            lead = False
    return Solution(found, sum(found.values()), bound)


def fullest(left: np.ndarray, first: int, size: int) -> np.ndarray:
    """Counts by length: `first` and the fullest completion by pieces of left, of equal ones that with longer pieces."""
    counts = np.zeros(len(left), np.int64)
    counts[first] = 1
    room = size - first
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        many = min(int(left[length]) - (length == first), room // length)
        before, k = reach, 1
        while many > 0:  # copies by doubling
            k = min(k, many)
            reach |= reach << (k * length) & mask
            many -= k
            k *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room:
            break
    at = reach.bit_length() - 1
    for length, before in reversed(steps):
        while not before >> at & 1:
            counts[length] += 1
            at -= length
    return counts


def filled(left: np.ndarray, first: int, size: int, worth: float) -> np.ndarray:
    """Counts by length: `first` and its best fit of pieces of left, where each further piece costs `worth` tokens."""
    rest, room = left.copy(), size - first
    rest[first] -= 1
    own = np.flatnonzero(rest[: room + 1])
    counts = np.zeros(len(left), np.int64)
    counts[first] = 1
    if not len(own):
        return counts
    floor = np.zeros(room + 1, np.int64)
    floor[own] = own
    floor = np.maximum.accumulate(floor)
    second = floor[room - own]
    pair = np.where((second > 0) & ((second != own) | (rest[own] > 1)), own + second, 0)
    at = len(pair) - 1 - int(pair[::-1].argmax())
    one, two = int(floor[room]), int(pair[at])
    beside, gap = ([one], room - one) if room - one <= room - two + worth else ([int(own[at]), int(second[at])], room - two + worth)
    if gap > 2 * worth:  # more pieces may do better
        more = fullest(left, first, size)
        if room + first - int(more @ np.arange(len(left))) + worth * (int(more.sum()) - 2) < gap:
            return more
    for length in beside:
        counts[length] += 1
    return counts


def take_whole(plan: list, left: np.ndarray, counts: np.ndarray, most: int | None = None) -> int:
    """Uses a configuration as often as left, and `most`, allow."""
    used = counts > 0
    times = int((left[used] // counts[used]).min())
    times = times if most is None else min(times, most)
    if times > 0:
        plan.append((counts, times))
        left -= counts * times
    return max(times, 0)


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Best fits of the longest piece left; the best of some worths of a piece, as it depends on how many short ones there are."""
    plans = []
    for worth in (0.5, 2.0, 4.0, 8.0, 12.0, 16.0):
        left, plan = histogram.copy(), []
        while left.any():
            take_whole(plan, left, filled(left, int(np.flatnonzero(left)[-1]), size, worth))
        plans.append(plan)
    return min(plans, key=lambda p: sum(times for _, times in p))


def rounded(histogram: np.ndarray, size: int, rounds: int) -> tuple[list[tuple[np.ndarray, int]], Solution]:
    """Whole numbers of configurations that place every piece, and the LP's solution.

    Amounts are rounded down and the LP of the rest is solved anew, at last with configurations less tight; then best fits.
    """
    left, plan, first = histogram.copy(), [], None
    for slack in (2e-4, 2e-3):
        if left.any():
            solution = fractional(left, size, rounds, slack)
            first = first or solution
            for counts, x in solution.configurations():
                take_whole(plan, left, counts, int(x + 1e-6))
    plan += best_fit(left, size)
    return plan, first or Solution({}, 0.0, 0.0)


def plan_of(histogram: np.ndarray, size: int = 1024, rounds: int = 40) -> list[tuple[np.ndarray, int]]:
    """The rounded LP; its size is bounded by `rounds` and `size`, not by the corpus."""
    if not histogram.any():
        return []
    plan, solution = rounded(histogram, size, rounds)
    used, pieces = sum(times for _, times in plan), int(histogram.sum())
    log.info("packing: %d pieces, LP value %.1f, lower bound %.1f, %d sequences", pieces, solution.value, solution.bound, used)
    return plan


def places(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces a sequence, first offset of each configuration that holds it."""
    out: dict[int, list[tuple[int, ...]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for counts, times in plan:
        offset = 0
        for length in np.flatnonzero(counts).tolist()[::-1]:
            many = int(counts[length])
            out.setdefault(length, []).append((rank.get(length, 0), base, many, offset))
            rank[length] = rank.get(length, 0) + many * times
            offset += many * length
        base += times
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in out.items()}


def pack(pieces: DataFrame, size: int = 1024, rounds: int = 40) -> DataFrame:
    """Adds sequence_id and offset to pieces (checkpointed, with part and local)."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = cut(by_part.withColumn("before", before), 16)
    histogram = np.zeros(size + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row.length] = row.n
    table = places(plan_of(histogram, size, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = int(length[some[0]])
                start, base, many, first = table[own]
                at = np.searchsorted(start, rank[some], "right") - 1
                k = rank[some] - start[at]
                sequence[some] = base[at] + k // many[at]
                offset[some] = first[at] + k % many[at] * own
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(by_part.select("length", "part", "before"), ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, size: int = 1024, rounds: int = 40) -> DataFrame:
    return pack(cut(pieces_of(docs, vocabulary, pattern, size)), size, rounds)
