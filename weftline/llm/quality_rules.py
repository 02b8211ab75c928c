"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character classes and its counts of its language's common words are compared to the same
histograms of all documents in that language by Jensen-Shannon distance. Minimum-length guards keep short
documents, whose histograms say little, from being judged by them. Repetition and length rules come first.

Null texts have no words and fail the length rule. A null or undeclared language is compared to all documents
by character classes alone. Repeated rows are judged alike; extra columns are ignored by measure() and kept by
keep_good(). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WS, cut, hidden, let

#: Function words by language: what a text in it can hardly do without.
COMMON = {
    "en": "the of and to in is that for it was on are as with be at by this from or".split(),
    "fr": "de la le et les des en un du une que est pour dans qui sur par pas au plus".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo como".split(),
}
#: Character classes; what is left over, mostly lower-case letters, is the last.
CLASSES = (r"\p{Lu}+", r"[0-9]+", r"[\x20\x09-\x0D]+", "[.,]+", r"[!-+\-/:-@\[-`{-~]+")
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Jensen-Shannon distances (base 2, 0 to 1) from which a document is unlike its language.
    max_char_distance: float = 0.25
    max_word_distance: float = 0.15
    #: Short texts stray from any reference: the word limit is higher by this over the root of the number of words.
    word_slack: float = 1.7
    #: Characters and words from which the histograms count.
    min_chars: int = 100
    min_common_words: int = 60
    common: dict[str, list[str]] = field(default_factory=lambda: COMMON)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by hash, those of equal hash by their words."""

    def twice(rows: Column, key: str) -> Column:
        """Those of sorted rows that share their key with a neighbour."""
        same = lambda row, k, d: F.coalesce(F.get(rows, k + d)[key] == row[key], F.lit(False))
        return F.filter(rows, lambda row, k: same(row, k, -1) | same(row, k, 1))

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def exact(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        texts = let(by_hash, lambda rows: F.sort_array(F.transform(twice(rows, "h"), lambda row: F.struct(window(row["i"]).alias("t"), row["i"].alias("i")))))
        return let(F.sort_array(F.transform(let(texts, lambda rows: twice(rows, "t")), lambda row: row["i"])), _reach)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(h))))


def _reach(places: Column) -> Column:
    """Words in windows of three that begin at the sorted places."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """docs with the base counts, base_failed, reference key and the two histograms (arrays of counts)."""
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("lang").isin(list(limits.common)), F.col("lang")).otherwise("")
    own = docs.withColumn("_words", F.array_remove(F.split(text, WS), ""))

    def counts(listed: list[str]) -> Column:
        plain = F.filter(F.transform(F.col("_words"), lambda w: F.lower(F.rtrim(w, F.lit(".,")))), lambda w: w.isin(listed))
        return let(plain, lambda p: F.array(*[(F.size(p) - F.size(F.array_remove(p, w))).cast("double") for w in listed]))

    common = F.lit(None).cast("array<double>")
    for lang, listed in limits.common.items():
        common = F.when(F.col("_key") == lang, counts(listed)).otherwise(common)
    chars = let(F.array(F.length(text), *[_without(text, c) for c in CLASSES]), lambda a: F.array(*[(a[0] - a[k]).cast("double") for k in range(1, len(CLASSES) + 1)], F.aggregate(F.slice(a, 2, len(CLASSES)), a[0], lambda rest, k: rest - (a[0] - k)).cast("double")))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    own = own.withColumn("_key", key).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": _without(text, WS).cast("long"),
            "n_symbols": (F.length(text) - _without(text, SYMBOLS + "+")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _n_repeat_words(F.col("_words")).cast("long"),
            "_chars": chars,
            "_common": common,
            # a filter on the verdict isn't pushed below a column like this one, where it would repeat the measures
            "_row": F.monotonically_increasing_id(),
        }
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return own.withColumn("base_failed", failed).drop("_words")


def references(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Histograms of documents by language, and of all together under the key '': one row a declared language and one.

    Documents under the least number of words say nothing about a language and are left out.
    """
    measured = measured.where(F.col("n_words") >= limits.min_words)
    width = max(map(len, limits.common.values()))
    sums = [F.sum(F.col("_chars")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("_common", F.lit(k))).alias(f"w{k}") for k in range(width)]
    sums.append(F.sum(F.when(F.col("_common").isNotNull(), F.col("n_words"))).alias("n"))
    by_lang = measured.rollup("_key").agg(*sums, F.grouping("_key").alias("_all")).where("_all = 1 or _key != ''")
    return by_lang.select(F.coalesce("_key", F.lit("")).alias("_key"), F.array(*[f"c{k}" for k in range(len(CLASSES) + 1)]).alias("_ref_chars"), F.array(*[F.coalesce(f"w{k}", F.lit(0.0)) for k in range(width)]).alias("_ref_common"), F.col("n").cast("double").alias("_ref_n"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda x, n: F.when(n > 0, x / n)

    def terms(sums: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            a, b = share(x, sums[0]), share(y, sums[1])
            part = lambda u: F.when(u > 0, u * F.log2(2 * u / (a + b))).otherwise(0.0)
            return part(a) + part(b)

        js = F.aggregate(F.zip_with(p, q, one), F.lit(0.0), lambda s, x: s + x)
        return F.when((sums[0] > 0) & (sums[1] > 0), F.sqrt(F.greatest(F.lit(0.0), js / 2)))

    return let(F.array(total(p), total(q)), terms)


def judge(measured: DataFrame, refs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Adds char_distance, word_distance and kept."""
    both = measured.join(F.broadcast(refs), "_key", "left")  # refs: one row a declared language
    size = F.size("_common")
    with_rest = lambda counts, n: F.concat(F.slice(counts, F.lit(1), size), F.array(F.greatest(F.lit(0.0), n - F.aggregate(F.slice(counts, F.lit(1), size), F.lit(0.0), lambda s, x: s + x))))
    word_distance = distance(with_rest(F.col("_common"), F.col("n_words").cast("double")), with_rest(F.col("_ref_common"), F.col("_ref_n")))
    both = both.withColumns({"char_distance": distance(F.col("_chars"), F.col("_ref_chars")), "word_distance": F.when(F.col("_common").isNotNull(), word_distance)})
    odd_chars = (F.col("word_chars") >= limits.min_chars) & (F.coalesce("char_distance", F.lit(0.0)) > limits.max_char_distance)
    odd_words = (F.col("n_words") >= limits.min_common_words) & (F.coalesce("word_distance", F.lit(0.0)) > limits.max_word_distance + limits.word_slack / F.sqrt("n_words"))
    return both.withColumn("kept", ~(F.col("base_failed") | odd_chars | odd_words))


_RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def judge_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The counts and verdict of each row; texts are measured once, their measures stored for both passes."""
    measured = cut(measure(docs.select("doc_id", "text", "lang"), limits).drop("text"))
    return judge(measured, references(measured, limits), limits).select(*_RESULT)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The rows of docs that pass, with their own columns. Reads docs twice: only the histograms the first time."""
    own = hidden(docs, "text", "lang")
    refs = cut(references(measure(docs.select("text", "lang"), limits).select("_key", "_chars", "_common", "n_words"), limits), 64)
    return judge(measure(own, limits), refs, limits).where("kept and _row >= 0").select(*own.columns).toDF(*docs.columns)
