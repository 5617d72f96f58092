"""Connected components of links between long keys, by alternating large-star and small-star steps.

Each step is a grouping and a join on one key; a hub's links are aggregated before they move and
AQE splits the join that brings its least neighbour back. Links are written to the shared folder
between rounds, so lineage stays short. Work ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Gives links of the same components, nearer to their least keys."""
    both = links.union(links.select("b", "a")) if large else links
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every key in links of (a, b); root is the least key of the component.

    Links of a key with itself and null keys count for nothing; repeated links count once; without links there are no rows.
    """
    at = frames.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        next_at = frames.written(_star(_star(at, True), False), "links")
        frames.drop(at)
        at = next_at
        new = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        if new == state:
            break
        state = new
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b").distinct())
