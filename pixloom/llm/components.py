"""Connected components by alternating large and small stars.

Each task first joins the edges it holds, so that rounds are needed only for what
the edges of several tasks share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, written

#: Edges that a task joins at once.
AT_ONCE = 1 << 18


def _find(parent: np.ndarray | list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent[:] = up


def _joint_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): every node of these edges, but the least of each component of theirs, on that least one."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(node)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = _find(parent, x), _find(parent, y)
        parent[max(x, y)] = min(x, y)
    root = _roots(np.array(parent, np.int64))
    low = np.nonzero(root != np.arange(len(node)))[0]
    return node[low], node[root[low]]


def _shortened(edges: DataFrame) -> DataFrame:
    """edges (u, v), AT_ONCE of a task's at a time, as stars: as many at most, and no long ways to be walked in rounds."""

    def run(batches):
        held, n = [], 0

        def out():
            u, v = _joint_stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= AT_ONCE:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges (u, v) with u > v in and out.

    Large: every neighbour above u hangs on the least of u and its neighbours.
    Small: every neighbour below u, and u, hang on the least of them.
    Neighbours of a hub are spread over tasks.  A repeated row of the large star
    changes no least, so rows are made distinct once a round.
    """
    least = [F.min("v").alias("m")], [F.min("m").alias("m")]
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = grouped(both, "u", ["v"], *least).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    small = grouped(large, "u", ["v"], *least)
    return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u, v) either hangs on one node that hangs on none, or hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1")).alias("n")).first().n


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b: longs); component is the least node reachable.

    Each round is written to the shared folder, so neither lineage nor a lost
    executor makes earlier rounds run again.  Ends when the edges are stars,
    after O(log^2 n) rounds; edges that come as stars need none.  Loops (a = b),
    repeated edges and nulls are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(_shortened(now).distinct(), "edges")
    while not _are_stars(now):
        now = written(_stars(now), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
