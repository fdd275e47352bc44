"""Running sums over a whole table without a window in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.plans.stage import cut, semi_join

#: Rows of a piece that one task adds up.
PIECE_ROWS = 1_000_000


def running_total(df: DataFrame, key: str, value: str, out: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """df with out = sum of value over all rows of a lesser key (exclusive). key must be unique and numeric.

    The rows are dealt into ranges of the key, as many as their number asks for, and cut; totals of the ranges (a row each) are
    added up first, then each range by itself. The result doesn't depend on where the ranges end.
    """
    d = cut(df)
    pieces = max(1, -(-d.count() // piece_rows))
    d = cut(d.repartitionByRange(pieces, key).withColumn("_piece", F.spark_partition_id()))
    whole = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    sums = d.groupBy("_piece").agg(F.sum(value).alias("_sum")).select("_piece", F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_piece").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    d = semi_join(d.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))), cut(sums), ["_piece"])
    return d.withColumn(out, F.col("_before") + F.col("_inner")).drop("_piece", "_before", "_inner")
