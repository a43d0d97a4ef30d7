"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or no larger) neighbours point to the least of its neighbourhood instead."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, root of every node of links (columns u, v): root is the least node that can be reached.

    Rounds grow with the logarithm of the nodes; each is written to the shared folder.  Null ends are ignored.
    """
    now = written(links.where("u <> v").select("u", "v").distinct(), "links", links.count())
    state = (now.count(), None)
    while True:
        now = written(_star(_star(now, True), False), "stars", state[0])
        # Settled: every link leads to a node that is no other's source, and a round changes neither number nor sum.
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        state = tuple(row)
