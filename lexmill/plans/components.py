"""Connected components by alternating large and small stars; log-many rounds, no group is ever collected, and the rows of a hub stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.stage import cut, split_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node of the edges; the component is its least node. Self-loops and nulls are left out."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
        large = cut(split_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = split_join(large, low, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
