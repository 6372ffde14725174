"""Connected components of an undirected edge list, with nodes leaving on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.operators.skew import skew_join
from clubledger.session import remove_written, write_counted, write_through


def _mixed(node: Column) -> Column:
    """Another 64-bit number, one for each: shifts and exclusive ors that can be undone.

    Neighbours tend to have neighbouring numbers; in a mixed order about half of the
    nodes of a long chain leave in every round."""

    def step(x: Column, _: Column) -> Column:
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        return x.bitwiseXOR(F.shiftleft(x, 17))

    # As a loop over four numbers: written out, the expression would double each time.
    return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), node, step)


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return edges.where("a <> b").select(ends.alias("e")).select("e.*").distinct()


def _round(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int, int]:
    """One round: ``(edges, tree, number of edges, number of tree rows)`` after it.

    Every node tells its neighbours and itself the smallest node among them. A node
    ties all that it has heard of to the smallest of them, its parent. Who is nobody's
    smallest, not even its own, has nothing more to say and leaves for the tree."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    told = skew_join(edges, low, "a", "inner").select(F.col("b").alias("node"), "low")
    heard = told.unionByName(low.withColumnRenamed("a", "node")).distinct()
    heard = write_through(heard, "heard")
    best = heard.groupBy("node").agg(
        F.min("low").alias("parent"), F.bool_or(F.col("low") == F.col("node")).alias("stays")
    )
    ties = skew_join(heard, best.select("node", "parent"), "node", "inner")
    following, n_edges = write_counted(
        _both_ways(ties.select(F.col("low").alias("a"), F.col("parent").alias("b"))), label
    )
    tree, n_tree = write_counted(best.where(~F.col("stays")).select("node", "parent"), "tree")
    remove_written(heard)
    return following, tree, n_edges, n_tree


def _roots(tree: DataFrame, depth: int) -> DataFrame:
    """``(node, root)`` of all nodes of a tree of this depth: each looks at its parent's
    parent, which doubles its reach, until the reach is the depth."""
    reach, tree = 1, tree.withColumnRenamed("parent", "root")
    while reach < depth:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        further = skew_join(tree, above, "root").select(
            "node", F.coalesce("higher", "root").alias("root")
        )
        tree, reach = write_through(further, "roots"), 2 * reach
    return tree


def connected_components(
    edges: DataFrame, report: Callable[[int, int], None] | None = None
) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, two bigint columns.

    The component is the smallest node in it. In every round the nodes that are no
    longer smallest anywhere near leave the edges; they keep a parent, and these
    parents make a tree from which the labels are handed back at the end (Cracker,
    Lulli et al., 2017). The edges left become fewer from round to round, and the rounds
    grow with the logarithm of the component's size. Each round writes its tables
    to the shared folder, and the tables before it go. A node with very many edges is
    split over tasks by Spark. ``report`` is told edges left and nodes gone per round.
    """
    named = F.explode(F.array("a", "b")).alias("node")
    nodes = write_through(
        edges.select(named).distinct().withColumn("mixed", _mixed(F.col("node"))), "nodes"
    )
    mixed = edges.select(_mixed(F.col("a")).alias("a"), _mixed(F.col("b")).alias("b"))
    current, n_edges = write_counted(_both_ways(mixed), "edges")
    trees = []
    while n_edges:
        following, tree, n_edges, n_gone = _round(current, "edges")
        remove_written(current)
        current = following
        trees.append(tree)
        if report:
            report(n_edges, n_gone)
    if not trees:
        return nodes.select("node", F.col("node").alias("component"))
    whole = trees[0]
    for tree in trees[1:]:
        whole = whole.unionByName(tree)
    roots = _roots(whole, len(trees)).withColumnRenamed("node", "mixed")
    placed = nodes.join(roots, "mixed", "left").select("node", F.coalesce("root", "mixed").alias("root"))
    placed = write_through(placed, "placed-nodes")
    smallest = placed.groupBy("root").agg(F.min("node").alias("component"))
    return skew_join(placed, smallest, "root", "inner").select("node", "component")
