"""Embedding near-dedup by NN-descent over distinct vectors.

Equal vectors are one node with a multiplicity. A first neighbour graph comes from a few tables of random
hyperplane signatures, whose buckets are read in order of a projection, a bounded stretch at a time. Rounds of
NN-descent follow: around each node the vectors of its neighbours and reverse neighbours meet, and what is nearer
than a list's last enters it. Links at the threshold give components. Lists that are full of links are too
short to count them, so they are enlarged to the whole component: its members are compared in blocks, and
only counts leave a block. An audit compares a bounded sample of nodes outside the largest component with all
and asks for further tables while its linked nodes, on average, have too few of their links in one component or
are too few to tell. If all tables leave that open, all nodes are compared block against block.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Vectors of
different lengths are never compared. Cosines are of doubles. Repeated ids are rows of their own in the counts;
a null id takes part and gets its component. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut
from weftline.llm.components import connected_components, stars

STRETCH, OVERLAP, SIDE, WIDE, GROWN = 1024, 64, 512, 4096, 64


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    neighbours: int = 8
    tables: int = 6
    rounds: int = 2
    audit: int = 128
    recall: float = 0.99
    most_tables: int = 24


def _vectors(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors, in double precision, of stored doubles of one length."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def stored(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vec: the vector's doubles as bytes, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 1024):
                for values in batch.column(1).slice(k, 1024).to_pylist():
                    blob = None
                    if values and None not in values:
                        x = np.array(values, np.float64) + 0.0  # no negative zero
                        with np.errstate(over="ignore"):
                            norm = np.linalg.norm(x)
                        if norm and np.isfinite(x).all():
                            blob = (x if np.isfinite(norm) and norm > 1e-150 else x / np.abs(x).max()).tobytes()
                    out.append(blob)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(vectors[key].alias("vec_id"), column).mapInArrow(run, f"vec_id {kind}, vec binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None, overlap: int = 0) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted rows; of a longer group, stretches of at most `most` rows that overlap."""
    now, rows, fresh = None, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now or (most and len(rows) >= most):
                if fresh:
                    yield now, rows
                rows = rows[-overlap:] if row[:keys] == now and overlap else []
                now, fresh = row[:keys], 0
            rows.append(row[keys:])
            fresh += 1
    if fresh:
        yield now, rows


def _pairs(u: list, v: list, s: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "sim"])


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """Each row's k nearest of the others."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
    for i, row in enumerate(near):
        for j in row:
            yield int(ids[i]), int(ids[j]), float(sims[i, j])


def bucketed(nodes: DataFrame, first: int, last: int, bits: int, settings: Settings) -> DataFrame:
    """(u, v, sim) from signature tables first to last; links that connect a stretch have sim 2 (besides its nearest pairs)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size in {len(b) for b in blobs}:
                at = [i for i, b in enumerate(blobs) if len(b) == size]
                x = _vectors([blobs[i] for i in at])
                for t in range(first, last):
                    if (t, size) not in planes:
                        planes[t, size] = np.random.default_rng((t, size)).standard_normal((x.shape[1], bits + 1))
                    y = x @ planes[t, size]
                    code = (y[:, :bits] > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(at), t)), pa.array(np.full(len(at), size)), pa.array(code), pa.array(y[:, bits]), pa.array([ids[i] for i in at], pa.int64()), pa.array([blobs[i] for i in at], pa.binary())], ["t", "size", "code", "along", "u", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3, STRETCH, OVERLAP):
            if len(rows) > 1:
                ids, x = np.array([r[1] for r in rows]), _vectors([r[2] for r in rows])
                found = list(_best(ids, x, settings.neighbours))
                i, j = np.nonzero(np.triu(x @ x.T >= settings.threshold, 1))
                joined = stars(ids[i], ids[j]) if len(i) else None
                if joined is not None:
                    found += [(u, v, 2.0) for u, v in zip(joined.column(0).to_pylist(), joined.column(1).to_pylist(), strict=True)]
                yield _pairs(*(list(c) for c in zip(*found, strict=True)))

    rows = nodes.select("u", "vec").mapInArrow(spread, "t long, size long, code long, along double, u long, vec binary")
    return rows.repartition("t", "size", "code").sortWithinPartitions("t", "size", "code", "along", "u").mapInArrow(meet, "u long, v long, sim double")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def descend(graph: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """One round: neighbours of neighbours meet around each node, and lists keep their nearest."""
    k = settings.neighbours
    back = _nearest(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), k)
    hood = graph.select("u", "v").union(back.select("u", "v")).union(nodes.select("u", F.col("u").alias("v"))).distinct()
    rows = hood.join(nodes.select(F.col("u").alias("v"), "vec"), "v").select("u", F.octet_length("vec").alias("size"), "v", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(batches, 2):  # at most 2k + 1 members
            if len(members) > 1:
                found = list(_best(np.array([m[0] for m in members]), _vectors([m[1] for m in members]), 3))
                yield _pairs(*(list(c) for c in zip(*found, strict=True)))

    met = rows.repartition("u").sortWithinPartitions("u", "size", "v").mapInArrow(meet, "u long, v long, sim double")
    return _nearest(graph.union(met), k)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links.select("u", "v"))
    return cut(nodes.select("u").join(found.withColumnRenamed("id", "u"), "u", "left").withColumn("component", F.coalesce("component", "u")))


def audit(nodes: DataFrame, components: DataFrame, settings: Settings) -> tuple[int, float, bool]:
    """Sampled nodes that have links, their mean share of links within their component, and whether that suffices.

    A missed link has an end outside the largest component, so the sample is of those nodes alone. It is compared
    with all nodes and grows until `audit` of it have links, all are in it, or it is `audit` times GROWN.
    """
    placed = components.join(nodes, "u").select("u", "vec", "component")
    largest = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).collect()
    outside = placed.where(F.col("component") != largest[0].component) if largest else placed
    size, seen, recalls = settings.audit, 0, []
    while True:
        sample = outside.orderBy(F.xxhash64("u"), "u").limit(size).collect()[seen:]  # those before are compared already
        recalls += _recalls(placed, sample, settings.threshold)
        whole = seen + len(sample) < size
        if whole or len(recalls) >= settings.audit or size >= GROWN * settings.audit:
            break
        seen, size = size, 4 * size
    mean = float(np.mean(recalls)) if recalls else 1.0
    return len(recalls), mean, mean >= settings.recall and (whole or len(recalls) >= settings.audit)


def _recalls(placed: DataFrame, sample: list, threshold: float) -> list[float]:
    """For each sampled row (u, vec, component) that has links: the share of them within its component."""
    ids, homes, blobs = [r.u for r in sample], np.array([r.component for r in sample], np.int64), [bytes(r.vec) for r in sample]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SIDE):
                own, vecs, home = (c.to_pylist() for c in batch.slice(k, SIDE).columns)
                for size in {len(b) for b in vecs}:
                    mine, theirs = [i for i, b in enumerate(vecs) if len(b) == size], np.array([i for i, b in enumerate(blobs) if len(b) == size], int)
                    if len(theirs):
                        near = _vectors([vecs[i] for i in mine]) @ _vectors([blobs[i] for i in theirs]).T >= threshold
                        near &= np.array([own[i] for i in mine])[:, None] != np.array([ids[i] for i in theirs])
                        true, found = near.sum(0), (near & (np.array([home[i] for i in mine])[:, None] == homes[theirs])).sum(0)
                        some = true > 0
                        yield pa.record_batch([pa.array(theirs[some]), pa.array(true[some]), pa.array(found[some])], ["at", "true", "found"])

    counts = placed.mapInArrow(compare, "at long, true long, found long").groupBy("at").agg((F.sum("found") / F.sum("true")).alias("recall"))
    return [r.recall for r in counts.collect()] if sample else []  # at most one number a sampled row


def missed_links(nodes: DataFrame, components: DataFrame, settings: Settings) -> DataFrame:
    """(u, v): all links between different components, by comparing all nodes block against block."""
    placed = components.join(nodes, "u").select("u", "vec", "component", F.octet_length("vec").alias("size"))
    sizes = placed.groupBy("size").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("k"))
    members = placed.join(sizes, "size").withColumn("own", F.pmod(F.xxhash64("u"), F.col("k")).cast("int"))
    each = members.select("size", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"), "own", "u", "component", "vec")
    keyed = each.select("size", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "u", "component", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):  # two blocks of about WIDE members
            u, home, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), _vectors([r[2] for r in rows])
            for k in range(0, len(u), SIDE):
                i, j = np.nonzero((x[k : k + SIDE] @ x.T >= settings.threshold) & (home[k : k + SIDE, None] != home))
                if len(i):
                    yield stars(u[k + i], u[j])

    return keyed.repartition("size", "a", "b").sortWithinPartitions("size", "a", "b").mapInArrow(compare, "u long, v long")


def link_counts(nodes: DataFrame, components: DataFrame, settings: Settings) -> DataFrame:
    """(u, links): vectors that each node's links lead to, counted block against block within its component."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    members = components.join(sizes, "component").join(nodes, "u")
    blocks = F.ceil(F.col("n") / SIDE).cast("int")
    members = members.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("u"), F.col("k")).cast("int"))
    each = members.select("component", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"), "own", "u", "m", "vec")
    keyed = each.select("component", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "own", "u", "m", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), rows in _groups(batches, 3):  # two blocks of about SIDE members
            own, u, m = (np.array([r[c] for r in rows]) for c in range(3))
            x = _vectors([r[3] for r in rows])
            near = x @ x.T >= settings.threshold
            np.fill_diagonal(near, False)
            if a != b:
                near &= own[:, None] != own[None, :]
            yield pa.record_batch([pa.array(u), pa.array(near @ m)], ["u", "links"])

    counts = keyed.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(compare, "u long, links long")
    return counts.groupBy("u").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """vec_id, n_links, component_id, kept for each row."""
    rows = cut(stored(vectors))
    usable = rows.where("vec is not null")
    # a vector whose rows have no id goes by a hash of it
    nodes = cut(usable.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")).select(F.coalesce(F.col("least").cast("long"), F.xxhash64("vec")).alias("u"), "m", "vec"))
    nameless = bool(usable.where("vec_id is null").limit(1).count())
    # a repeated id with two vectors would be one node twice: such nodes are told apart by a hash
    twice = nodes.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    if twice:
        nodes = cut(nodes.withColumn("u", F.xxhash64("u", "vec")))
    bits = min(24, max(4, int(np.log2(max(1, nodes.count()) / 16 + 1)) + 1))
    graph, links, tables = None, None, 0
    while True:
        more = min(settings.tables, settings.most_tables - tables)
        pairs = cut(bucketed(nodes, tables, tables + more, bits, settings))
        tables += more
        near = _nearest(pairs.where("sim < 1.5"), settings.neighbours)
        graph = cut(near if graph is None else _nearest(graph.union(near), settings.neighbours))
        for _ in range(settings.rounds):
            graph = cut(descend(graph, nodes, settings))
        new = pairs.where("sim > 1.5").union(graph.where(F.col("sim") >= settings.threshold)).select("u", "v")
        links = new if links is None else links.union(new)
        components = _components(nodes, links)
        if audit(nodes, components, settings)[2]:
            break
        if tables >= settings.most_tables:
            missed = cut(missed_links(nodes, components, settings))
            components = _components(nodes, links.union(missed))
            break
    counts = cut(link_counts(nodes, components, settings))
    named = nodes.join(components, "u").join(counts, "u", "left")
    if twice or nameless:
        ids = usable.groupBy("vec").agg(F.min("vec_id").alias("least"))
        named = named.join(ids, "vec")
    else:
        named = named.withColumn("least", F.col("u"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "component").select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    out = rows.join(named, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
