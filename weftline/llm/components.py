"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two keyed shuffles with a map-side minimum, the number of steps grows with the logarithm of the
graph's size, and lineage is cut after each, so a lost executor costs one step. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a batch to a star of each of its components: (member, least member)."""
    for batch in batches:
        u, v = (batch.column(c).to_numpy() for c in (0, 1))
        yield stars(u, v)


def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:  # names are sorted, so the least index is the least member
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = root != np.arange(len(names))
    return pa.record_batch([pa.array(names[some]), pa.array(names[root[some]])], ["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 60, share: int = 16) -> DataFrame:
    """(id, component) for every end of edges (u, v: long): component is the least id reachable. Loops and repeats are fine."""
    now = cut(edges.select("u", "v").where("u != v").mapInArrow(forest, "u long, v long").distinct(), share)
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now = cut(small, share)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if seen == state or seen[0] == seen[2] and _is_flat(now):
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _is_flat(stars_now: DataFrame) -> bool:
    """Every node has one parent already; flat if no parent has one."""
    return stars_now.join(stars_now.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").isEmpty()
