"""Connected components of a graph given as links, by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node around it, small-star
does the same with the smaller ones; after a logarithmic number of rounds every node points
to the smallest of its component.  Each round is two aggregations and two joins (hot nodes
are pre-aggregated, and adaptive execution splits their joins), and ends with a table
written to the shared folder.  Nothing but a row count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, materialise


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of a link between
    different nodes.  Nodes are numbers; null ends and links to itself are ignored.  Rounds go on until nothing
    changes."""
    star = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    star = materialise(star, "components")
    before = None
    while True:
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                       F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old = star
        star = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                           .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(old)
