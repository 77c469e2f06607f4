"""Connected components by alternating large-star and small-star rounds.

Each round is a map-side combined minimum and an equi-join, so a node with very many links is summed before it is
shuffled and its join partition can be split. Rounds are written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.llm.shared import materialize


def _star(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with a > b, distinct. Large star: neighbours above a node move to the least of its neighbourhood."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = links.select(ends).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # Small star: neighbours below a node, and the node itself, move to the least of them.
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a")
    moved = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable ids -> (node, root): the least id reachable, for each node that has a link to another.

    Loops, repeated and reversed links are allowed, links with a null end are ignored; no links give an empty result.
    """
    now = materialize(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # The rounds are done when they change nothing: as many links with the same ends.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
        now = materialize(_star(now))
