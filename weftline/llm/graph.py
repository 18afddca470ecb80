"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, release

#: Steps towards the root that one pass of _rooted takes at most.
STEPS = 3


def _downwards(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) with u > v for the edges between different nodes."""
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def _joined(edges: DataFrame, node: str, parents: DataFrame) -> DataFrame:
    """edges with __p, the parent of the column node; null for roots."""
    up = parents.select(F.col("u").alias("__u"), F.col("v").alias("__p"))
    return edges.join(up, F.col(node) == F.col("__u"), "left").drop("__u")


def _rooted(parents: DataFrame) -> DataFrame:
    """The root of each node, from a table of cut() with one parent each: (u, v), where every v is less than its u."""
    while True:
        step = parents.select("u", "v")
        for _ in range(STEPS):
            step = _joined(step.select("u", "v"), "v", parents).select("u", F.coalesce("__p", "v").alias("v"), F.col("__p").isNotNull().alias("more"))
        before, parents = parents, cut(step)
        release(before)
        if parents.where("more").isEmpty():
            return parents


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its least node.

    In rounds: every node takes its least smaller neighbour as parent, nodes
    move to the roots of these trees, and the edges between different roots
    are the next round's. A root without a node of its own has a smaller
    neighbour in the next round, so two rounds halve the nodes at least. The
    sums are combined before they are shuffled, and a node with very many
    neighbours is only ever on the side of a join that Spark splits. Loops,
    repeated edges and nulls are harmless. stored: edges come from a table
    and need not be written.
    """
    now, first = _downwards(edges, "a", "b"), None
    if not stored:
        now = first = cut(now)
    trees = []
    while True:
        trees.append(_rooted(cut(now.groupBy("u").agg(F.min("v").alias("v")))))
        left = _joined(now, "u", trees[-1]).withColumnRenamed("__p", "a")
        left = _downwards(_joined(left, "v", trees[-1]).select("a", F.coalesce("__p", "v").alias("b")), "a", "b")
        if left.isEmpty():
            break
        now = cut(left.distinct())
        if first is not None:
            release(first)
        first = now
    if first is not None:
        release(first)
    found = trees[0]
    if len(trees) > 1:  # a node has a parent in one round alone, so the trees are trees together
        every = trees[0].select("u", "v")
        for t in trees[1:]:
            every = every.unionByName(t.select("u", "v"))
        found = _rooted(cut(every))
        release(*trees)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
