"""Connected components of an edge table by contraction.

Each task reduces its edges to a forest of stars by union-find; a node that stars of several tasks share then links their
roots. Those links are a much smaller graph, contracted in the same way until none are left, and labels are joined back
level by level. No edge leaves the cluster, and a node with very many edges appears once for each task. Nodes are of any one
type that can be ordered; edges with a null end are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.storage import materialize
from causeway.plans.shipping import ship

#: Edges that a task holds before it passes its stars on.
HELD_EDGES = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's component, for edges between numbers below ``n``."""
    parent = np.arange(n)
    while True:  # hook the larger root to the smaller, then halve all paths
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges, with the least node of each component as root."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    return nodes, nodes[roots(len(nodes), index[: len(u)], index[len(u) :])]


def _stars_of(edges: pa.Table) -> pa.RecordBatch:
    """``stars`` of Arrow columns of any type: nodes are numbered in their order."""
    ends = pa.chunked_array(edges.column(0).chunks + edges.column(1).chunks).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    number = place[ends.indices.to_numpy()]
    found = roots(len(order), number[: edges.num_rows], number[edges.num_rows :])
    nodes = ends.dictionary.take(order)
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(found))], ["node", "root"])


def _contract(edges: DataFrame) -> DataFrame:
    """(node, root, others): the least root that some task gave the node, and its other roots."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD_EDGES:
                yield _stars_of(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield _stars_of(pa.Table.from_batches(held))

    kind = edges.schema["u"].dataType.simpleString()
    found = edges.mapInArrow(local, f"node {kind}, root {kind}")
    grouped = found.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    return grouped.select("node", "root", F.array_remove("roots", F.col("root")).alias("others"))


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; a root is the least node of its component."""
    ship(edges.sparkSession)
    levels = []
    current = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    while True:
        level = materialize(_contract(current), "stars")
        levels.append(level.select("node", "root"))
        current = level.where(F.size("others") > 0).select(F.explode("others").alias("u"), F.col("root").alias("v"))
        if current.isEmpty():
            break
    labels = levels.pop()
    while levels:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = levels.pop().join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return labels
