"""Connected components of a link table by alternating large-star and small-star contraction.

Every round is two grouped minima and two joins on the link table; links, labels and components stay distributed.
Rounds grow with the logarithm of the longest path. Each round is written and the one before it deleted. Rounds end when
the links are stars, which one grouped pass tells: then no node has two links down, or both links up and down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _are_stars(links: DataFrame) -> bool:
    """Whether each node of (a, b), b < a, is either once an a or only ever a b."""
    ends = links.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long), undirected, no nulls -> (node, label): label is the least node of its component.

    Only nodes that occur in a link between two different nodes are returned.
    """
    links = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _are_stars(links):
        links = durable(_small_star(_large_star(links)), instead_of=links)
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
