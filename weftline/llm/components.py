"""Connected components: spanning forests of parts of the edges, then alternating large-star and small-star steps over what
is left, each round a written table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


#: Edges that one task contracts to a spanning forest.
PART = 2_000_000


def labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i - j: least labels along them, with jumps, until they agree."""
    while True:
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label[i] == label[j]).all():
            return label


def roots(label: np.ndarray) -> np.ndarray:
    while (label != label[label]).any():
        label = label[label]
    return label


def _forest(batches):
    """Of a part's edges (u, v): each node but the least of its component, with that least one."""
    held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = roots(labels(np.arange(len(names)), at[: len(u)], at[len(u) :]))
        rest = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[rest]), pa.array(names[label[rest]])], names=["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least node around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable. Nodes without an edge have no row; null ends and self links are ignored.

    Many links among few nodes, as large groups have, first shrink to at most one a node in each part of PART links.
    The rounds needed grow with the logarithm of the component size. A node of high degree meets only
    aggregates (min) and joins against one row a node, which adaptive execution can split."""
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u <> v").distinct()
    every = written(flat, "links")
    now = written(every.coalesce(max(1, -(-every.count() // PART))).mapInArrow(_forest, "u long, v long").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        then = written(_small(_large(now)), "edges")
        found = _mark(then)
        now = then
        if found == mark:
            break
        mark = found
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
