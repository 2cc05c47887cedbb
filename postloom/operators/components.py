"""Connected components by contraction: no part of the graph is collected, and the graph shrinks each round."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage


def _contraction(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): every node goes to whichever of itself and its neighbours comes first in an order drawn anew each turn."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("place"), F.col(c).alias("node"))
    first = both.groupBy("a").agg(F.min(order("b")).alias("best"))
    return first.select(F.col("a").alias("node"), F.least(order("a"), "best")["node"].alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, root): nodes of one component, and no others, have one root.

    A turn is a group-wise minimum, combined before the shuffle, and two joins with one row per node. With the order
    drawn anew, a chain keeps about a third of its nodes each turn, so the number of turns grows with the logarithm
    of the longest chain and the work with the size of the graph. The root is some node of the component. Edges from a
    node to itself are ignored; a node without another edge is not returned.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = cut_lineage(edges.filter("a <> b").select(*pair("a", "b")).distinct(), "component-edges")
    turns: list[DataFrame] = []
    while not live.isEmpty():
        to = cut_lineage(_contraction(live, len(turns)), "component-turn")
        turns.append(to)
        ends = (live.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b"))
        live = cut_lineage(ends.filter("ta <> tb").select(*pair("ta", "tb")).distinct(), "component-edges")
    if not turns:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = turns.pop().withColumnRenamed("to", "root")
    while turns:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = cut_lineage(turns.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "component-roots")
    return roots
