"""Connected components of a graph given as a DataFrame of edges.

Every round contracts the graph: each node points to its smallest neighbour,
pointers are followed to their roots, edges are rewritten between roots, and
loops and repeats fall away.  The minimum of a node's neighbours is a plain
aggregate (combined before the shuffle, so hubs are harmless) and the joins
put a small key-to-root table against a written one, which adaptive execution
can split where a hub makes it uneven.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches; by min-label hooking with pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        u, v = root[u], root[v]
        live = u != v
        u, v = u[live], v[live]
    return nodes, nodes[root]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each batch of edges by a star for each of its components."""
    for batch in batches:
        if batch.num_rows:
            node, root = forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            far = node != root
            yield pa.RecordBatch.from_arrays([pa.array(root[far], pa.int64()), pa.array(node[far], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges``: two long columns a, b.  Returns node, component (the smallest node reachable) for every node of an edge.

    Null ends, loops and repeated edges are allowed and change nothing; an
    empty table gives an empty result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edge = scratch.save(edges.mapInArrow(_local_forests, "a long, b long").distinct(), f"{tag}-e0")
    node = None
    rounds = 0
    while edge.limit(1).count():
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        point = scratch.save(point, f"{tag}-p{rounds}-0")
        jump = 0
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            nxt = scratch.save(point.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")), f"{tag}-p{rounds}-{jump + 1}")
            scratch.drop(f"{tag}-p{rounds}-{jump}")
            jump += 1
            point = nxt.select("node", "root")
            if not nxt.where("moved").limit(1).count():
                break
        ra, rb = point.select(F.col("node").alias("a"), F.col("root").alias("ra")), point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = edge.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        new = scratch.save(new, f"{tag}-e{rounds + 1}")
        if node is None:
            node = scratch.save(point, f"{tag}-n0")
        else:
            then = node.join(point.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            node = scratch.save(then, f"{tag}-n{rounds}")
            scratch.drop(f"{tag}-n{rounds - 1}")
        scratch.drop(f"{tag}-e{rounds}")
        edge, rounds = new, rounds + 1
    if node is None:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return node.select("node", F.col("root").alias("component"))
