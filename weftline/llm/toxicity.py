"""Toxicity by weak supervision.

Voters look at a text: one for each entry of a lexicon of words and word beginnings induced from labelled texts,
and patterns (how dense lexicon words are, several of them, shouting, exclamation, stretched letters). A
generative model explains the voters' agreement by a hidden label: each voter has an accuracy for either label,
found by expectation maximization over distinct vote rows; labels enter only through the lexicon and the
starting point. Voters that agree more than the hidden label explains share their weight (pairwise correlations
of residuals). A linear classifier over the same votes is then trained on the posterior labels.

Training reads a sample of labelled rows of at most `max_rows`, those with the least hash of their id, so the
bound is a parameter and the choice the same at every size. The model is some dozens of numbers; scoring is one
pass without a shuffle over all rows. Null texts are empty; empty texts have a score as well. Rows with a null
id are scored but never learnt from. Without labels, or with labels of one kind, every score is the share of
toxic labels (0 without any). Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut

_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_~`^+=/\\"
_END = "\0"  # after a whole word, so that a word and its beginning are different entries
_BEGINNINGS = range(3, 9)
_DENSITIES = (0.004, 0.008, 0.015)


@dataclass(frozen=True)
class Model:
    lexicon: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    @cached_property
    def voters(self) -> Voters:
        return Voters(self.lexicon)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w for w, v in zip(self.weights, self.voters(text or ""), strict=True) if v)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Voters:
    """One vote an entry of the lexicon, then the patterns'."""

    PATTERNS = len(_DENSITIES) + 5

    def __init__(self, lexicon: tuple[str, ...]):
        self._at = {entry: i for i, entry in enumerate(lexicon)}
        self._known: dict[str, int] = {}

    def _entry(self, token: str) -> int:
        word = token.lower().strip(_STRIP)
        for part in (word + _END, *(word[:n] for n in _BEGINNINGS if n <= len(word))):
            if part in self._at:
                return self._at[part]
        return -1

    def __call__(self, text: str) -> list[bool]:
        known, tokens = self._known, text.split()
        if len(known) > 200_000:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = self._entry(token)
        hits = Counter(map(known.__getitem__, tokens))
        hits.pop(-1, None)
        n, length = sum(hits.values()), max(1, len(tokens))
        shouting = sum(map(str.isupper, text)) * 2 > len(text) > 20
        return [*(i in hits for i in range(len(self._at))), *(n >= d * length and n > 0 for d in _DENSITIES), n >= 2, n >= 3, shouting, text.count("!") * 20 > len(text) > 20, bool(re.search(r"(\w)\1{4}", text))]


def _toxic_entries(sample: DataFrame, most: int, support: int) -> list[str]:
    """Words and beginnings of labelled texts (text, toxic) by lower bounds of their log odds among words and among texts."""
    words = F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(_STRIP))), lambda w: w != "")
    sample = sample.select("toxic", words.alias("words"))
    texts = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.sum(F.size("words") * F.col("toxic")).alias("wt"), F.sum(F.size("words")).alias("wn")).first()
    if not texts.n or not texts.t or texts.t == texts.n or not texts.wt:
        return []

    def parts(words: Column) -> Column:
        each = lambda w: F.array(F.concat(w, F.lit(_END)), *[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in _BEGINNINGS])
        return F.filter(F.flatten(F.transform(words, each)), lambda p: p.isNotNull())

    # every part of the sample counts; sums are partial before each shuffle, so it carries a part once a task
    tokens = sample.select("toxic", F.explode(parts(F.col("words"))).alias("part")).groupBy("part").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
    by_doc = sample.select("toxic", F.explode(F.array_distinct(parts(F.col("words")))).alias("part")).groupBy("part").agg(F.sum("toxic").alias("docs"), F.count("*").alias("all_docs"))
    counts = tokens.join(by_doc.where(F.col("docs") >= support), "part")
    free = F.col("all_docs") - F.col("docs")
    by_text = F.log((F.col("docs") + 0.5) / (texts.t + 1)) - F.log((free + 0.5) / (texts.n - texts.t + 1)) - 2 * F.sqrt(1 / (F.col("docs") + 0.5) + 1 / (free + 0.5))
    odds = F.log((F.col("t") + 0.5) / (texts.wt + 1)) - F.log((F.col("f") + 0.5) / (texts.wn - texts.wt + 1))
    ranked = counts.withColumn("low", odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("f") + 0.5))).where((F.col("low") > 1.8) & (by_text > 1.0))
    found = {r.part: r for r in ranked.orderBy(F.desc("docs"), F.desc("low"), "part").limit(50 * most).collect()}
    # of nested entries: the longest that still has nearly all the toxic texts, then the shortest of those
    longer = set()
    for p, row in found.items():
        for q in {p[:-1], p[:-2]} if p.endswith(_END) else {p[:-1]}:
            if q in found and row.docs >= 0.75 * found[q].docs and row.low >= found[q].low - 0.3:
                longer.add(q)
    rest = [p for p in found if p not in longer]
    kept = [p for p in rest if not any(p.startswith(q) for q in rest if q != p)]
    return kept[:most]


def label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of the hidden label for each distinct vote row, by EM with correlated voters sharing their weight."""
    n, total = votes.shape[1], counts.sum()
    hit = np.where(votes, 0.9, 0.1).max(1) if n else np.zeros(len(votes))
    post = np.where(hit > 0.5, 0.9, prior * 0.2)
    share = np.ones(n)
    for k in range(rounds):
        mass = counts * post
        on = (votes * mass[:, None]).sum(0)
        # Laplace terms keep rates from 0 and 1; a voter is believed to be better than chance
        alpha = np.clip((on + 1) / (mass.sum() + 2), 0.01, 0.99)
        beta = np.clip(((votes * (counts - mass)[:, None]).sum(0) + 0.1) / (total - mass.sum() + 2), 1e-5, 0.5)
        alpha = np.maximum(alpha, beta)
        if k == rounds // 2 and n > 1:  # correlations that the label leaves unexplained
            rate = post[:, None] * alpha + (1 - post[:, None]) * beta
            residual = (votes - rate) * np.sqrt(counts / total)[:, None]
            scale = np.sqrt((residual**2).sum(0)) + 1e-9
            corr = np.abs(residual.T @ residual / np.outer(scale, scale)) - np.eye(n)
            share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        base = np.clip(mass.sum() / total, 1e-4, 0.9)
        gain = (votes * np.log(alpha / beta) + (1 - votes) * np.log((1 - alpha) / (1 - beta))) * share
        post = 1 / (1 + np.exp(-np.clip(np.log(base / (1 - base)) + gain.sum(1), -30, 30)))
    return post


def linear(votes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a small ridge."""
    x = np.column_stack([votes.astype(float), np.ones(len(votes))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (counts * (labels - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_lexicon: int = 64, support: int = 5) -> Model:
    """The model from labelled rows that are not held out; at most max_rows of them."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most max_rows pairs of numbers
    sample = cut(sample)
    lexicon = tuple(_toxic_entries(sample, max_lexicon, support))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            rows = ["".join("01"[v] for v in voters(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.string()), batch.column(1)], ["votes", "toxic"])

    seen = sample.mapInArrow(run, "votes string, toxic long").groupBy("votes").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("votes").collect()
    counts = np.array([r.n for r in seen], float)
    toxic = float(sum(r.t for r in seen))
    if not lexicon:
        rate = toxic / counts.sum() if len(counts) else 0.0
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return Model((), (0.0,) * Voters.PATTERNS, float(np.log(rate / (1 - rate))))
    votes = np.array([[c == "1" for c in r.votes] for r in seen], bool)
    post = label_model(votes, counts, toxic / counts.sum())
    weights, bias = linear(votes, counts, post)
    return Model(lexicon, tuple(map(float, weights)), bias)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for k in range(0, batch.num_rows, 256) for t in batch.column(1).slice(k, 256).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
