"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The minima are a table of their own, so that the join is of two plain shuffles and a hub's links can be split.
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "down")
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has a link, ``root`` the smallest node reachable.

    ``edges`` has the long columns ``u`` and ``v``; direction, repeats and self links
    do not matter; links with a null are left out. Each round is two grouped minima and two joins over the links that are
    left, written to shared storage; it ends when a round changes nothing, which takes rounds in
    the order of the logarithm of the longest path. Nothing but a row count and a checksum reaches the driver. An
    empty table gives none.
    """
    now = materialise(edges.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = materialise(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
