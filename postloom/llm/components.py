"""Connected components of a graph given as a table of links, without collecting any of it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, root): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (Connected Components in MapReduce and Beyond).
    A round is a group-wise minimum, combined before the shuffle, and one join; a hot node only ever meets its own
    minimum. The number of rounds grows with the logarithm of the longest path, and each round is written down.
    Nodes without links are not returned.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "links")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = cut_lineage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = cut_lineage(small, "small-star")
        # a star forest: every node's only neighbour is its root; the sums change until then
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")),
                          F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
