"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch


def rank(node: Column, k: int) -> Column:
    """The place of a node in the order of round k: another permutation of all bigints in each round, so that no numbering of the nodes makes long chains."""
    return F.xxhash64(node, F.lit(k))


def forest(live: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(node, parent): each node of the edges (u, v) with the root of its tree, where each tree has two nodes at least.

    A node points to the neighbour that ranks first. Ranks fall with every second step, so the only cycles are of two nodes, of
    which the one that ranks first is the root. Then parents jump to theirs until none moves; trees are as deep as ranks fall in a row, so jumps are few.
    """
    both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.min_by("v", rank(F.col("v"), k)).alias("to")), f"to{k}")
    back = to.select(F.col("node").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("node")) & (rank(F.col("node"), k) < rank(F.col("to"), k))
    parent = scratch.write(to.join(back, "to").select("node", F.when(root, F.col("node")).otherwise(F.col("to")).alias("parent")), f"parent{k}-0")
    scratch.drop(f"to{k}")
    jumps, moved = 0, True
    while moved:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = parent.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        jumped = scratch.write(jumped, f"parent{k}-{jumps + 1}")
        moved = not jumped.where("moved").isEmpty()
        scratch.drop(f"parent{k}-{jumps}")
        parent, jumps = jumped.drop("moved"), jumps + 1
    return parent


def contracted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v), bigints -> (node, root): each node that has an edge to another, with one node of its component, the same for all of it.

    Each round makes one node of each tree of a forest and rewrites the edges to the trees' roots. At least half of the nodes that still have
    edges merge in a round, so rounds grow with the logarithm of the nodes and tables shrink by halves. What a node points to is aggregated
    before the shuffle, and a node with very many edges meets one row of the parents' table, in a join whose large partitions Spark splits.
    Null ends and self-loops are left out. No edges: no rows.
    """
    live = scratch.write(edges.where("u <> v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).distinct(), "edges0")
    parents: list[DataFrame] = []
    while not live.isEmpty():
        k = len(parents)
        parents.append(forest(live, scratch, k))
        to_u, to_v = (parents[-1].select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "uv")
        nxt = live.join(to_u, "u").join(to_v, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        live = scratch.write(nxt, f"edges{k + 1}")
        scratch.drop(f"edges{k}")
    if not parents:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = parents[-1].withColumnRenamed("parent", "root")
    for earlier in reversed(parents[:-1]):  # the smallest first
        step = out.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        out = earlier.join(step, "parent", "left").select("node", F.coalesce("above", "parent").alias("root"))
    return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """As `contracted`, with the least node of the component as its root."""
    out = scratch.write(contracted(edges, scratch), "rooted")
    return out.join(out.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root"))
