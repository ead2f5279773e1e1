"""Connected components of links that never leave the executors.

Links are first contracted in blocks of at most a million, each to a forest of roots. If there is more
than one block, alternating large-star and small-star steps (Kiveris et al., 2014) join the forests
until nothing changes. Minima are pre-aggregated before they
are shuffled, and a hub's links meet its minimum in a join whose skew Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.runtime import drop_staged, staged

#: Links that one task contracts at once (16 bytes each).
BLOCK = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes that are not the smallest."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (jump := root[root]).tolist() != root.tolist():
            root = jump
        if (before == root).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_u, held_v, size = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held_u, held_v, size
        u, v = contracted(np.concatenate(held_u), np.concatenate(held_v))
        held_u, held_v, size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held_u.append(np.asarray(batch["u"]))
        held_v.append(np.asarray(batch["v"]))
        size += batch.num_rows
        if size >= BLOCK:
            yield flush()
    if size:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. One step; again u > v, distinct."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """links: long columns u and v, in any direction. Returns node, label (the smallest node that it
    reaches) for the nodes that are not their own label. Links of a node with itself and nulls do nothing."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    raw = staged(edges, "links")
    blocks = max(1, -(-raw.count() // BLOCK))
    edges = staged(raw.coalesce(blocks).mapInArrow(_local, "u long, v long"), "links")
    drop_staged(raw)
    if blocks == 1:  # one forest: its roots are the smallest nodes
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # Each step lowers a node's parent or leaves all as they are, so this ends, in rounds logarithmic in the nodes.
    now, then = state(edges), None
    while now[0] and now != then:
        then = now
        following = staged(_star(_star(edges, True), False), "links")
        now = state(following)
        drop_staged(edges)
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
