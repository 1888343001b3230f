"""Connected components of a link table, by alternating star contractions on DataFrames.

Each round replaces every node's links by links to its smallest neighbour, first for the larger neighbours,
then for the smaller ones; after O(log² n) rounds every node hangs on the smallest node of its component.
Links are grouped with partial aggregation and joined by node (AQE splits a hub); each round is written to
the shared folder, so a lost executor repeats one round at most. Nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import drop_written, written

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """links (a > b) → each larger neighbour of a node linked to the smallest of node and neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a > b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """links (a > b) → a and its smaller neighbours linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) of any orderable type → (node, component): the smallest node reachable, for every node that
    has a link to another node. Null ends, loops and repeats are ignored; no links give an empty table."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a > b").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        new = written(_small_star(_large_star(now)), "links")
        # The table is a fixpoint when a round gives the same links: same count and same order-free checksum.
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = new
        if state == seen or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b"), F.col("b")).distinct())
        state = seen
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
