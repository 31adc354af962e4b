"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import Cut


def _oriented(df: DataFrame) -> DataFrame:
    return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b) of one orderable type; self-links and nulls are ignored, order and repeats don't matter.

    Returns (node, root): for every node that is linked to another one, the smallest node that it reaches. A node
    without links has no row; an empty table gives an empty table.

    Each step is a grouping by a link's larger end followed by an equi-join with that small result. A node with very
    many links makes a hot key only on the join's link side, which adaptive execution splits. Every table between two
    steps is written to the shared folder, so a step never depends on more than the one before it.
    """
    edges = Cut(_oriented(links.where("a is not null and b is not null").select("a", "b")), "links")
    for _ in range(max_rounds):
        low = Cut(edges.df.groupBy("a").agg(F.min("b").alias("low")), "low")
        above = low.df.select(F.col("a").alias("b"), F.col("low").alias("low_b"))
        # large star: a link's larger end moves to the smallest neighbour of its smaller end
        large = Cut(_oriented(edges.df.join(above, "b", "left").select("a", F.coalesce("low_b", "b").alias("b"))), "large")
        low2 = Cut(large.df.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), "low")
        # small star: what lies below a node meets at the smallest of it
        small = Cut(_oriented(large.df.join(low2.df.select("a", "low"), "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")), "small")
        roots = low2.df.select(F.col("a").alias("b"))
        done = low2.df.where("n > 1").isEmpty() and large.df.join(roots, "b", "left_semi").isEmpty()
        for x in (edges, low, large, low2):
            x.drop()
        edges = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
