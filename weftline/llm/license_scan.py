"""License scans by a trained paragraph classifier, in DataFrame functions only.

A softmax regression over word n-grams (one to three words) is trained on the driver on windows of public licence
texts and on sentences that only sound like them: constants of the package, so its size is fixed. Its sparse
weights are a small table that n-grams of paragraphs meet. Probabilities are scaled by a temperature fitted on
texts of their own, of which training sees nothing; a paragraph whose best family stays below the limit from which
those are right in 95 of 100 cases is unknown. A prediction counts when a template of its family confirms it: enough
of the shorter side's three-word shingles are shared (of a template of two words, the two).

Paragraphs are what blank lines separate, or lines in texts without any. Each is looked at: it is classified if it
has a word of licences or any shingle of any template, as a line of a wrapped licence has. No other paragraph can be
confirmed, so families and confirmed paragraphs are those of classifying all. The others count nowhere: what single
words of prose (the German "mit") make the classifier say is no finding. Unknown are paragraphs with a word of licences.
Null texts have no paragraph. Repeated rows get the same result; a null doc_id keeps its row; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let
from weftline.llm.license_templates import CALIBRATION, CALIBRATION_UNKNOWN, TEMPLATES, TRIGGERS, UNKNOWN

FAMILIES = tuple(TEMPLATES)
_SPLIT = r"[^a-z0-9.+-]+"


def words_of(text: str) -> list[str]:
    return [w for x in re.split(_SPLIT, text.lower()) if (w := x.strip(".-"))]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def shingles_of(words: list[str]) -> set[str]:
    """Three-word shingles; of fewer words, all of them."""
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


@dataclass(frozen=True)
class Model:
    """Rows: n-gram, weights by family (unknown last), templates whose shingle it is."""

    rows: tuple[tuple[str, tuple[float, ...], tuple[float, ...]], ...]
    bias: tuple[float, ...]
    temperature: float
    least: float
    shingles: tuple[int, ...]  # three-word shingles a template
    owner: tuple[int, ...]  # family of a template


@lru_cache(maxsize=1)
def model(rounds: int = 400) -> Model:
    samples: list[tuple[list[str], int]] = []
    for family, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = words_of(text)
            samples += [(words, family)] * 3
            for width in (8, 14, 24):
                samples += [(words[at : at + width], family) for at in range(0, max(1, len(words) - width + 1), 3)]
    samples += [(words_of(text), len(FAMILIES)) for text in UNKNOWN] * 2
    held = [(words_of(text), FAMILIES.index(f)) for f, texts in CALIBRATION.items() for text in texts]
    held += [(words_of(text), len(FAMILIES)) for text in CALIBRATION_UNKNOWN]
    vocabulary = sorted(set().union(*(grams_of(w) for w, _ in samples)))
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, (words, _) in enumerate(rows):
            for g in grams_of(words):
                if g in at:
                    x[i, at[g]] = 1
        return x, np.array([y for _, y in rows])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(samples)
    truth = np.eye(len(FAMILIES) + 1)[y]
    balance = (len(y) / (len(FAMILIES) + 1) / np.bincount(y, minlength=len(FAMILIES) + 1))[y][:, None]
    w = np.zeros((x.shape[1], truth.shape[1]))
    w[-1, -1] = 2.0  # nothing known: unknown
    for k in range(rounds):
        w -= (0.5 if k < rounds // 2 else 0.1) * (x.T @ ((softmax(x @ w) - truth) * balance) / len(y) * 4 + 2e-4 * w)
    w[-1] -= w[-1].mean()
    hx, hy = matrix(held)
    best = min((-(np.log(softmax(hx @ w / t)[np.arange(len(hy)), hy] + 1e-12)).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8))
    p = softmax(hx @ w / best[1])
    top, sure = p.argmax(1), p.max(1)
    # the limit above which held-out predictions of a family are right in 95 of 100 cases
    limits = [t for t in np.arange(0.3, 0.9, 0.05) if ((top < len(FAMILIES)) & (sure >= t)).any() and (hy[(top < len(FAMILIES)) & (sure >= t)] == top[(top < len(FAMILIES)) & (sure >= t)]).mean() >= 0.95]
    shingles = [shingles_of(words_of(text)) for texts in TEMPLATES.values() for text in texts]
    owner = tuple(f for f, texts in enumerate(TEMPLATES.values()) for _ in texts)
    every = sorted(set(vocabulary).union(*shingles))
    rows = tuple((g, tuple(map(float, w[at[g]])) if g in at else (0.0,) * truth.shape[1], tuple(float(g in s) for s in shingles)) for g in every)
    return Model(rows, tuple(map(float, w[-1])), float(best[1]), float(limits[0]) if limits else 0.9, tuple(map(len, shingles)), owner)


def judge(words: list[str], own: Model, share: float = 0.6) -> tuple[str, float, float]:
    """Plain form of the classifier: family or unknown, its probability, the best template's share."""
    table = {g: (w, t) for g, w, t in own.rows}
    found = [table[g] for g in grams_of(words) if g in table]
    z = np.array(own.bias) + sum((np.array(w) for w, _ in found), np.zeros(len(own.bias)))
    p = np.exp(z / own.temperature - (z / own.temperature).max())
    p /= p.sum()
    k = int(p.argmax())
    if k == len(FAMILIES) or p[k] < own.least:
        return "unknown", float(p[k]), 0.0
    n = len({" ".join(words[i : i + 3]) for i in range(len(words) - 2)})
    hits = sum((np.array(t) for _, t in found), np.zeros(len(own.owner)))
    shares = [hits[t] / max(1, min(n, own.shingles[t])) for t in range(len(own.owner)) if own.owner[t] == k]
    return FAMILIES[k], float(p[k]), float(max(shares))


def _paragraphs(text: Column) -> Column:
    return F.when(text.rlike(r"\n[ \t]*\n"), F.split(text, r"\n[ \t]*\n")).otherwise(F.split(text, "\n"))


def _words(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(paragraph), _SPLIT), lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != "")


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _meets_template(words: Column) -> Column:
    """Whether any template's shingle is in words; it is put together only where each word is at its place in one."""
    every = {tuple(s.split(" ")) for texts in TEMPLATES.values() for text in texts for s in shingles_of(words_of(text))}

    def of(n: int, own: list[tuple[str, ...]]) -> Column:
        def here(i: Column) -> Column:
            at = [F.get(words, i + k) for k in range(n)]
            return reduce(and_, [w.isin(sorted({s[k] for s in own})) for k, w in enumerate(at)]) & F.concat_ws(" ", *at).isin([" ".join(s) for s in own])

        return F.exists(F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)), here)

    return reduce(or_, [F.coalesce(of(n, sorted(s for s in every if len(s) == n)), F.lit(False)) for n in sorted(set(map(len, every)))])


def scan_paragraphs(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, _th, _row, pos, family, probability, share, confirmed, said: for each paragraph with a word of licences (said) or a template's shingle."""
    own, spark = model(), docs.sparkSession
    n, t = len(own.bias), len(own.owner)
    table = spark.createDataFrame(list(own.rows), "gram string, w array<double>, t array<double>")
    text = F.coalesce("text", F.lit(""))
    # numbered before the paragraphs are laid out: beside them, each paragraph would get a number of its own
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_th"), F.monotonically_increasing_id().alias("_row"))
    # the outer forms, as Spark would test the others' arrays first, and so make each of them twice
    each = rows.select("doc_id", "_th", "_row", F.posexplode_outer(_paragraphs(F.col("_text"))).alias("pos", "p"))
    said = F.coalesce(F.col("p").rlike(TRIGGERS), F.lit(False))
    grams = let(_words(F.col("p")), lambda w: let(said, lambda d: F.when(d | _meets_template(w), F.struct(d.alias("said"), _grams(w).alias("grams")))))
    counted = let(grams, lambda g: let(F.size(F.filter(g["grams"], lambda x: F.size(F.split(x, " ")) == 3)), lambda n3: F.transform(g["grams"], lambda x: F.struct(g["said"].alias("said"), n3.alias("n3"), x.alias("gram")))))
    each = each.select("doc_id", "_th", "_row", "pos", F.explode_outer(counted).alias("g")).where("g is not null")
    each = each.select("doc_id", "_th", "_row", "pos", "g.said", "g.n3", "g.gram")
    met = each.join(F.broadcast(table), "gram", "left")  # some thousand rows, fixed by the package
    sums = met.groupBy("doc_id", "_th", "_row", "pos", "said", "n3").agg(*[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(n)], *[F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(t)])
    z = F.array(*[(F.lit(b) + F.coalesce(f"w{k}", F.lit(0.0))) / own.temperature for k, b in enumerate(own.bias)])
    sums = sums.withColumn("z", z)
    top = F.array_max("z")
    sums = sums.withColumns({"k": F.array_position("z", top) - 1, "probability": 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top))})
    hits = [(F.coalesce(f"t{k}", F.lit(0.0)) / F.greatest(F.lit(1), F.least("n3", F.lit(m))), f) for k, (m, f) in enumerate(zip(own.shingles, own.owner, strict=True))]
    best = F.greatest(*[F.when(F.col("k") == f, h).otherwise(0.0) for h, f in hits])
    known = (F.col("k") < len(FAMILIES)) & (F.col("probability") >= own.least)
    family = F.when(known, F.array(*map(F.lit, FAMILIES))[F.least(F.col("k"), F.lit(len(FAMILIES) - 1)).cast("int")]).otherwise("unknown")
    out = sums.withColumns({"share": F.when(known, best).otherwise(0.0), "family": family})
    return out.select("doc_id", "_th", "_row", "pos", "family", "probability", "share", (known & (F.col("share") >= share)).alias("confirmed"), "said")


def scan_documents(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_confirmed, n_unconfirmed, n_unknown (with a word of licences): for each row."""
    found = scan_paragraphs(docs, share).groupBy("doc_id", "_th", "_row").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(~F.col("confirmed") & (F.col("family") != "unknown")).alias("n_unconfirmed"),
        F.count_if(F.col("said") & (F.col("family") == "unknown")).alias("n_unknown"),
    )
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(*[F.first(c).alias(c) for c in ("families", "n_confirmed", "n_unconfirmed", "n_unknown")])
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    return both.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_confirmed", "n_unconfirmed", "n_unknown")])
