"""Small computed tables for training: schedules, grids, scaling law, token filters, resuming."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as T


def lr_schedule(spark: SparkSession, kind: str, warmup: int, total: int, lr: float, min_lr: float, decay: float = 0.1) -> DataFrame:
    """(step, lr) for steps 0 .. total - 1: warm-up, then 'wsd' (constant, linear decay over the last share) or 'cosine'."""
    if kind not in ("wsd", "cosine") or not 0 <= warmup < total or min_lr > lr:
        raise ValueError("no such schedule")
    s = F.col("id")
    rise = F.lit(lr) * (s + 1) / max(warmup, 1)
    if kind == "wsd":
        start = total - max(1, int(total * decay))
        last = max(1, total - start)
        rest = F.when(s < start, F.lit(lr)).otherwise(F.lit(lr) - (lr - min_lr) * (s - start + 1) / last)
    else:
        span = max(1, total - warmup - 1)
        rest = F.lit(min_lr) + 0.5 * (lr - min_lr) * (1 + F.cos(F.lit(math.pi) * F.least((s - warmup) / span, F.lit(1.0))))
    return spark.range(total).select(s.alias("step"), F.round(F.when(s < warmup, rise).otherwise(rest), 9).alias("lr"))


def parameters(v, d, layers, f, heads):
    """Estimate of a decoder's parameters."""
    return v * d + layers * (4 * d * d + 3 * d * f + 2 * d + 2 * F.floor(d / heads))


def architecture_grid(spark: SparkSession, vocab: int, d_models, n_layers, n_heads, d_ffs, least: int, most: int) -> DataFrame:
    """(d_model, n_layers, n_heads, d_ff, n_params): valid presets within the budget, nearest to its middle first (as rank)."""
    g = spark.range(1, numPartitions=1)
    for name, values in (("d_model", d_models), ("n_layers", n_layers), ("n_heads", n_heads), ("d_ff", d_ffs)):
        g = g.select("*", F.explode(F.array(*(F.lit(x).cast("bigint") for x in values))).alias(name))
    g = g.drop("id")
    g = g.where("d_model % n_heads = 0 and (d_model div n_heads) % 2 = 0")
    g = g.withColumn("n_params", parameters(F.lit(vocab), F.col("d_model"), F.col("n_layers"), F.col("d_ff"), F.col("n_heads")).cast("bigint")).where(F.col("n_params").between(least, most))
    near = F.abs(F.col("n_params") - (least + most) / 2)
    return g.withColumn("rank", F.row_number().over(Window.orderBy(near, "d_model", "n_layers", "n_heads", "d_ff")))


def scaling_law(points: DataFrame) -> DataFrame:
    """n_params, n_tokens -> loss, perplexity, accuracy by a published law."""
    x = 1.69 + F.pow(F.col("n_params") / 6.7e3, F.lit(-0.34)) + F.pow(F.col("n_tokens") / 1.8e5, F.lit(-0.28))
    return points.select("n_params", "n_tokens", F.round(x, 6).alias("loss"), F.round(F.exp(x), 4).alias("perplexity"), F.round(F.exp(-x), 6).alias("accuracy"))


def nucleus(scores: DataFrame, top_p: float, top_k: int | None = None) -> DataFrame:
    """(group, item, prob) that stay: the k best, then those before which less than top_p of the mass lies. scores: group, item, logit; a group is one distribution."""
    w = Window.partitionBy("group")
    order = w.orderBy(F.desc("logit"), "item")
    s = scores.where("logit is not null")
    if top_k:
        s = s.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top_k).drop("_k")
    s = s.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("prob", F.col("e") / F.sum("e").over(w))
    before = F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("prob")
    return s.withColumn("before", before).where(F.col("before") <= top_p).select("group", "item", F.round("prob", 6).alias("prob"))


def resume(start_step: int, accumulation: int, batches_per_epoch: int) -> tuple[int, int]:
    """(epoch, batches to skip in it) after start_step updates; the last window of an epoch may be shorter."""
    per_epoch = -(-batches_per_epoch // accumulation)
    epoch, step = divmod(start_step, per_epoch)
    return epoch, step * accumulation


def shuffled(df: DataFrame, seed: int, epoch: int, skip: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, h) of an epoch's order, by the hash of seed + epoch; the first `skip` rows are left out."""
    d = df.select(key, F.md5(F.concat(F.lit(f"{seed + epoch}-"), F.col(key).cast("string")).cast("binary")).alias("h"))
    if not skip:
        return d
    gone = d.orderBy("h", key).limit(skip).agg(F.max(F.struct("h", key)).alias("m"))
    return d.crossJoin(F.broadcast(gone)).where(F.col("m").isNull() | (F.struct("h", key) > F.col("m"))).drop("m")


def prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): turns in order as 'User: ...' and 'Assistant: ...' lines; a conversation is bounded by its turns."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    t = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(who, F.coalesce("text", F.lit(""))).alias("line")))).alias("t"))
    return t.select("conv_id", F.concat(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit("\nAssistant:")).alias("prompt"))


def last_tokens(ids: Column, context: int, new: int) -> Column:
    """The last tokens of a prompt that leave room for `new` ones in the context."""
    room = max(context - new, 0)
    return F.when(F.size(ids) > room, F.slice(ids, F.greatest(F.size(ids) - room + 1, F.lit(1)), room)).otherwise(ids)


def reply(generated: Column) -> Column:
    """Generated text up to the next turn of the user, stripped."""
    return T.strip(F.substring_index(generated, "User:", 1))


def human_count(c: Column) -> Column:
    """1.2B, 35.8M, 12.0K or the number."""
    f = lambda d, u: F.concat(F.format_string("%.1f", c / F.lit(float(d))), F.lit(u))
    return F.when(c >= 1e9, f(1e9, "B")).when(c >= 1e6, f(1e6, "M")).when(c >= 1e3, f(1e3, "K")).otherwise(c.cast("string"))
