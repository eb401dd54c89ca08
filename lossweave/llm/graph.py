"""Connected components of an edge table by contraction to stars and pointer jumping.

Edges are contracted inside each task first (union-find, at most one edge per
node and task leaves it), so the rounds work on about as many edges as nodes,
and a node with very many neighbours has one edge from each task.  Nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.staging import drop, stage

EDGE = "hi long, lo long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest connected node) for every node of the edges whose smallest is another."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # each edge hooks the larger root onto the smaller; roots then jump until flat
        rx, ry = root[x], root[y]
        live = rx != ry
        if not live.any():
            break
        x, y, rx, ry = x[live], y[live], rx[live], ry[live]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges as a star forest, folded as they come so that memory follows the nodes."""
    hi, lo = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        hi, lo = forest(np.concatenate([hi, a]), np.concatenate([lo, b]))
    for i in range(0, len(hi), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(hi[i : i + 50_000]), pa.array(lo[i : i + 50_000])], ["hi", "lo"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node id.

    Self-loops and repeated edges change nothing; an edge with a null end is ignored; no edges, no rows.

    A round brings a node's edges together, where they are contracted to stars,
    and lets each node jump to its parent's smallest parent.  A task also makes
    stars of nodes whose other edges lie in other tasks, so nothing is left to do
    only once each node has one parent and no parent has a parent of its own.
    Until then a round lowers some edge's ends and raises none, so rounds end.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("hi"), F.col(b).cast("long").alias("lo")).where("hi is not null and lo is not null and hi <> lo")
    e = e.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).mapInArrow(contract, EDGE)
    before = None
    while True:
        stars = stage(e.repartition("hi").mapInArrow(contract, EDGE).distinct(), "edges")
        if before is not None:
            drop(before)
        before = stars
        above = stars.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("top"), F.max("lo").alias("most"))
        if above.where("top <> most").isEmpty() and stars.join(above, "lo", "left_semi").isEmpty():
            break
        e = stars.join(above, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"))
    return spark.createDataFrame([], "node long, component long").union(stars).union(stars.select("lo", "lo").distinct())
