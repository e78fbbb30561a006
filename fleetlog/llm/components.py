"""Connected components of a link table by alternating large and small stars, in DataFrame operations.

Every round is written to the session's shared folder, so a lost executor costs one round. A hot
centre is only ever the key of a partial minimum and of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import stored


def components(links: DataFrame) -> DataFrame:
    """Links (a, b), in either direction and repeated -> (node, root) of every node with a link.

    ``root`` is the smallest node that can be reached, itself included.
    """
    edges = stored(_down(links.where("a <> b").select("a", "b")), "links")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than the node hangs on the smallest neighbour or the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _down(both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours hang on the smallest of them."""
    low = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = edges.join(low, edges.a == low.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))))
