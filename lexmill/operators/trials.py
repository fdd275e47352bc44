"""Trials of a tuning study: parameters resolved, counts by state, the best ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESET = ("d_model", "n_layers", "n_heads", "d_ff")


def preset(d_model: Column, n_layers: Column, n_heads: Column, d_ff: Column) -> Column:
    """An architecture as one string: d_model=..,n_layers=..,n_heads=..,d_ff=.."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in zip(PRESET, (d_model, n_layers, n_heads, d_ff))))


def preset_value(c: Column, key: str) -> Column:
    """A value of such a string; null without it."""
    return F.element_at(F.str_to_map(c, F.lit(","), F.lit("=")), key).cast("bigint")


def derived_d_ff(d_model: Column) -> Column:
    """Width of the inner layer for a model width: eight thirds, rounded up to even."""
    raw = F.floor(d_model * 8 / 3)
    return (raw + raw % 2).cast("bigint")


def tokens_per_second(steps: Column, batch: Column, accumulation: Column, context: Column, seconds: Column) -> Column:
    """Tokens that training went through a second; null without a duration."""
    return F.try_divide(steps * batch * accumulation * context, seconds)


def resolved(trials: DataFrame) -> DataFrame:
    """trials with d_model, n_layers, n_heads, d_ff and min_lr filled in: from architecture_preset, else as given, else derived from d_model and learning_rate."""
    have = set(trials.columns)
    own = lambda k, t="bigint": F.col(k).cast(t) if k in have else F.lit(None).cast(t)
    values = {k: F.coalesce(preset_value(F.col("architecture_preset"), k), own(k)) if "architecture_preset" in have else own(k) for k in PRESET}
    t = trials.withColumns(values)
    t = t.withColumn("d_ff", F.coalesce("d_ff", derived_d_ff(F.col("d_model"))))
    return t.withColumn("min_lr", F.coalesce(own("min_lr", "double"), own("learning_rate", "double") * 0.1)).drop("architecture_preset")


def by_state(trials: DataFrame) -> DataFrame:
    """(state, n, best): trials and least value of each state."""
    return trials.groupBy("state").agg(F.count("*").alias("n"), F.min(F.when(~F.isnan("value"), F.col("value"))).alias("best"))


def best(trials: DataFrame, n: int = 5) -> DataFrame:
    """The n complete trials of least value, ties by number, with their rank; trials without a value come last, NaN counts as none."""
    value = F.when(~F.isnan("value"), F.col("value"))
    t = trials.where(F.col("state") == "COMPLETE").orderBy(F.asc_nulls_last(value), "number").limit(n)
    return t.agg(F.array_sort(F.collect_list(F.struct(value.isNull().alias("none"), F.col("value").alias("v"), F.col("number").alias("k"), F.struct(*trials.columns).alias("row")))).alias("r")).select(
        F.posexplode("r").alias("rank", "r")
    ).select((F.col("rank") + 1).cast("bigint").alias("rank"), "r.row.*")
