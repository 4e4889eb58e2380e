"""Connected components of a table of links, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise


def stars(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for each node that has a link (u, v) to another, the smallest node it is connected with, unless itself.

    Each round every node passes its neighbours the smallest node it knows; the links become stars around the roots
    after about log(n) rounds. Tables are written between rounds; only a count and a sum reach the driver.
    """
    e = materialise(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = hot_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(e, least, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return materialise(e.select(F.col("u").alias("node"), F.col("v").alias("root")))
        seen = state
    raise RuntimeError("components did not settle")
