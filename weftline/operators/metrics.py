"""Measures of what a rendering keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(targets: DataFrame, documents: DataFrame, words: int = 4, at_once: int = 1000) -> DataFrame:
    """(item_id, documents): documents whose text holds the target's.

    Both sides meet on shingles of the texts: a target's second to fifth word, whole words wherever it stands, and every
    shingle of a document. Only keys meet; the texts of what met are fetched and compared. Targets too short for a
    shingle meet every document, `at_once` of them in a pass, so what is broadcast has a bound.
    """
    split = lambda c: F.split(c, r"\s+")
    keyed = targets.select("item_id", F.col("text").alias("target"), F.array_join(F.slice(split("text"), 2, words), " ").alias("k"), F.size(split("text")).alias("n"))
    long, short = keyed.where(F.col("n") >= words + 2), keyed.where(F.col("n") < words + 2)
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, F.lit(words)), " "))
    each = documents.select("doc_id", split("text").alias("w")).where(F.size("w") >= words).select("doc_id", F.explode(F.array_distinct(shingles)).alias("k"))
    pairs = each.join(long.select("item_id", "k"), "k").select("item_id", "doc_id").distinct()
    met = pairs.join(documents.select("doc_id", "text"), "doc_id").join(long.select("item_id", "target"), "item_id").where(F.contains("text", "target")).select("item_id", "doc_id")
    passes = -(-short.count() // at_once)
    for k in range(passes):
        some = short.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)  # about at_once rows
        met = met.union(documents.join(F.broadcast(some), F.contains(documents["text"], F.col("target"))).select("item_id", "doc_id"))
    counts = met.distinct().groupBy("item_id").agg(F.count("*").alias("documents"))
    return targets.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
