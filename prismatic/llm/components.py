"""Connected components of links between numbers, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WRITTEN, discard, materialize, skew_join


def components(links: DataFrame) -> DataFrame:
    """(node, component: the smallest node it reaches) for the nodes of links (a, b). No links give no rows.

    Each round joins every node to the smallest of its neighbourhood, first over larger neighbours, then over smaller ones, until nothing
    changes; the number of rounds follows the logarithm of the nodes. Rounds are written to the shared folder; the last one stays.
    """
    since = len(WRITTEN)
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(skew_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars-large")
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "stars")
        discard(now.sparkSession, since, -1)  # earlier rounds
