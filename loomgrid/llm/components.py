"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, written


def _extent(links: DataFrame) -> tuple:
    """Number and checksum of links: equal where the links are."""
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component: the least node it is linked with, directly or not) of each node in links (a, b).

    Each round hooks all larger neighbours of a node to the least one, then all smaller neighbours; a row for a link is
    all that moves, and rounds grow with the logarithm of a component's width. Both steps are written tables. Nodes can
    be of any ordered type. The least neighbour of a node is found by an aggregate, which combines before it shuffles,
    and told to its links by a join that spreads nodes with very many links."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    extent = _extent(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = spread_join(both.where("b > a"), least, "a", 2 * extent[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least
        large = written(large.where("a <> b").distinct(), "links")
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = spread_join(large, floor, "a", extent[0]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        after = written(small.where("a <> b").distinct(), "links")
        dropped(now)
        dropped(large)
        now, before = after, extent
        if (extent := _extent(now)) == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError("components did not settle")
