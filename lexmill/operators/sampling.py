"""Reproducible samples: by a seeded hash of the id, exact in number, without sorting a whole class in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill import config as C

BUCKETS_HEX = 3  # hex digits of the hash that make a bucket: 4096


def rank_key(seed: int, c: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(c).cast("string")).cast("binary"))


def lowest(df: DataFrame, group: str, targets: dict[str, int], seed: int, key: str = "doc_id") -> DataFrame:
    """For each group in targets its `target` rows of least hash; groups without a target stay whole.

    Rows are counted by bucket of the hash; whole buckets are taken until the target falls into one, and only that
    bucket is ranked. A hot group so is never sorted in one task.
    """
    spark = df.sparkSession
    h = df.withColumn("_h", rank_key(seed, key)).withColumn("_b", F.conv(F.substring("_h", 1, BUCKETS_HEX), 16, 10).cast("int"))
    limits = []
    counts: dict[str, list] = {}
    for r in h.where(F.col(group).isin(*targets)).groupBy(group, "_b").agg(F.count("*").alias("n")).orderBy(group, "_b").collect():  # at most groups * 4096 rows
        counts.setdefault(r[0], []).append((r[1], r[2]))
    for g, most in targets.items():
        left, edge, rest = most, 1 << 30, 0
        for b, n in counts.get(g, []):
            if left < n:
                edge, rest = b, left
                break
            left -= n
        limits.append((g, edge, rest))
    if not limits:
        return df
    lim = spark.createDataFrame(limits, f"{group} string, _edge int, _rest bigint")
    h = h.join(F.broadcast(lim), group, "left")
    whole = h.where(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    part = h.where(F.col("_b") == F.col("_edge")).withColumn("_k", rank).where(F.col("_k") <= F.col("_rest"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def few(df: DataFrame, group: str, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """The k rows of least hash of every group. k is small: each task keeps its own k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(rank_key(seed, key), key))
    return df.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def topic_resample(df: DataFrame, config: C.Config | None = None, topic: str = "topic") -> DataFrame:
    """Classes of the distribution cut to their share of the rows in topic_classes; what is missing isn't made up."""
    config = config or C.Config()
    df = df.where(F.col(topic).isin(*config.topic_classes))
    total, weights = df.count(), sum(config.topic_distribution.values())
    targets = {k: int(total * w / weights) for k, w in config.topic_distribution.items()}
    return lowest(df, topic, targets, config.seed)


def docs_for_budget(tokens: int) -> int:
    """Documents to draw so that about `tokens` tokens are left after filtering."""
    return math.ceil(tokens / C.TOKENS_PER_DOC / (1 - C.ATTRITION))


def budget_sample(df: DataFrame, tokens: int, seed: int) -> DataFrame:
    """Documents for a token budget in seeded order."""
    one = df.withColumn("_all", F.lit("all"))
    return lowest(one, "_all", {"all": docs_for_budget(tokens)}, seed).drop("_all")


def first_rows(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n rows of least key: a top-k, no sort of the whole."""
    return df.orderBy(key).limit(n)
