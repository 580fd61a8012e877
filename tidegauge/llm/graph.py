"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, jumps: int = 3) -> DataFrame:
    """doc, component (its smallest reachable doc) for every doc with a link; ``links`` has a and b.

    In a round every node points to its smallest neighbour, pointers are followed a few times, and the
    links are redrawn between the nodes pointed to. A round makes a path several times shorter and a
    star a single node; it ends when no links are left.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = to = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to")))
        for _ in range(jumps):
            to = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.to").alias("to"))
        to = cut(to)
        first = found is None
        if first:
            found = to.select(F.col("v").alias("doc"), F.col("to").alias("component"))
        else:
            moved = found.join(to, F.col("component") == F.col("v"), "left")
            old, found = found, cut(moved.select("doc", F.coalesce("to", "component").alias("component")))
            discard(old)
        at = lambda side: F.col(f"{side}.to")
        drawn = links.join(to.alias("p"), F.col("a") == F.col("p.v")).join(to.alias("q"), F.col("b") == F.col("q.v"))
        drawn = drawn.select(F.least(at("p"), at("q")).alias("a"), F.greatest(at("p"), at("q")).alias("b"))
        old, links = links, cut(drawn.filter("a <> b").distinct())
        discard(old, near, None if first else to)  # the first round's is read by ``found``
    return found if found is not None else links.select(F.col("a").alias("doc"), F.col("b").alias("component"))
