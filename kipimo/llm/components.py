"""Connected components of a link table, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of the links (a, b); comp is one of its component's nodes.

    Each round merges every node into its smallest neighbour (if that is smaller) and
    keeps the links between what is left.  Nodes are expected to be hashes, so that
    chains shrink by a fraction each round.  A hot node is pre-aggregated, and links to
    it become one after the first round.
    """
    edges = staged(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(
            both.groupBy("a")
            .agg(F.min("b").alias("low"))
            .select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        )
        if labels is None:
            labels = step.select("node", F.col("to").alias("comp"))
        else:
            moved = step.select(F.col("node").alias("comp"), "to")
            labels = staged(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = staged(
            edges.join(left, "a")
            .join(right, "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
