"""Run analytics: metric series, checkpoints. Runs are partitions of windows; within one, lines are in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill import config as C
from lexmill.plans.stage import cut


def lines(metrics: DataFrame) -> DataFrame:
    """One row for each (run_name, line_no): the one logged last; exact repeats collapse. Counted before the shuffle."""
    rest = [c for c in metrics.columns if c not in ("run_name", "line_no")]
    last = metrics.groupBy("run_name", "line_no").agg(F.max_by(F.struct(*rest), F.coalesce("logged_at", F.timestamp_seconds(F.lit(0)))).alias("r"))
    return last.select("run_name", "line_no", "r.*")


def nan_free(c: str) -> Column:
    return F.when(F.isnan(c), None).otherwise(F.col(c))


#: Lines of a run that one row of the blockwise passes holds.
BLOCK_LINES = 1024


def smoothed(metrics: DataFrame, alpha: float = 0.98) -> DataFrame:
    """(run_name, step, train_loss, ema): exponential mean s = alpha * s + (1 - alpha) * x from the first loss on; lines without a loss are left out.

    A run is cut into blocks of BLOCK_LINES lines. A block maps the mean before it to decay * mean + rest; these pairs are
    composed along the run, and then all blocks are gone through side by side, each from its own start. So a long run is many
    tasks, and only one row a block comes together.
    """
    s = lines(metrics).where(F.col("record_type") == "step").select("run_name", "line_no", "step", nan_free("train_loss").alias("x")).where("x is not null")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "step", "x"))).alias("r")
    blocks = cut(s.groupBy("run_name", F.floor(F.col("line_no") / BLOCK_LINES).alias("block")).agg(rows))
    # From zero, as if the block were alone: what it adds, and how much of the mean before it is left.
    rest = F.aggregate("r", F.lit(0.0), lambda a, v: a * alpha + v["x"] * (1 - alpha))
    pairs = blocks.select("run_name", "block", rest.alias("rest"), F.pow(F.lit(alpha), F.size("r")).alias("decay"), F.col("r")[0]["x"].alias("first"))

    def starts(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        mean, out = None, []
        for rest, decay, first in zip(*(t.column(c).to_pylist() for c in ("rest", "decay", "first"))):
            out.append(first if mean is None else mean)
            mean = out[-1] * decay + rest
        return pa.table({"run_name": t.column("run_name"), "block": t.column("block"), "start": pa.array(out, pa.float64())})

    begin = pairs.groupBy("run_name").applyInArrow(starts, "run_name string, block bigint, start double")
    joined = blocks.join(begin, ["run_name", "block"])

    def run(batches):
        for b in batches:
            names, steps, xs, emas = [], [], [], []
            for name, r, mean in zip(*(b.column(c).to_pylist() for c in ("run_name", "r", "start"))):
                for v in r:
                    mean = mean * alpha + v["x"] * (1 - alpha)
                    names.append(name)
                    steps.append(v["step"])
                    xs.append(v["x"])
                    emas.append(mean)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(steps, pa.int64()), pa.array(xs, pa.float64()), pa.array(emas, pa.float64())], names=["run_name", "step", "x", "ema"])

    out = joined.select("run_name", "r", "start").mapInArrow(run, "run_name string, step bigint, x double, ema double")
    return out.select("run_name", "step", F.round("x", 6).alias("train_loss"), F.round("ema", 6).alias("ema"))


def eval_points(metrics: DataFrame) -> DataFrame:
    """(run_name, line_no, step, val_loss, gap): evaluations with the last step before them; gap only if all evaluations of the run have a train loss."""
    w = Window.partitionBy("run_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    s = lines(metrics).withColumn("at", F.last(F.when(F.col("record_type") == "step", F.col("step")), ignorenulls=True).over(w))
    e = s.where(F.col("record_type") == "eval").withColumn("t", nan_free("eval_train_loss")).withColumn("v", nan_free("val_loss"))
    every = F.min(F.col("t").isNotNull()).over(Window.partitionBy("run_name"))
    return e.select("run_name", "line_no", F.coalesce("step", "at").alias("step"), F.round("v", 6).alias("val_loss"), F.round(F.when(every, F.col("v") - F.col("t")), 6).alias("gap"))


def best_steps(metrics: DataFrame) -> DataFrame:
    """(run_name, step, val_loss): the last best_checkpoint line of each run."""
    b = lines(metrics).where(F.col("record_type") == "best_checkpoint")
    return b.groupBy("run_name").agg(F.max_by(F.struct("step", "val_loss"), "line_no").alias("r")).select("run_name", "r.step", F.round("r.val_loss", 6).alias("val_loss"))


def summary(metrics: DataFrame) -> DataFrame:
    """(run_name, n_steps, last_step, least_val_loss, mean_tokens_per_sec)."""
    s = lines(metrics)
    return s.groupBy("run_name").agg(
        F.count_if(F.col("record_type") == "step").alias("n_steps"),
        F.max("step").alias("last_step"),
        F.round(F.min(nan_free("val_loss")), 6).alias("least_val_loss"),
        F.round(F.avg(nan_free("tokens_per_sec")), 4).alias("mean_tokens_per_sec"),
    )


def early_stop(metrics: DataFrame, patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """(run_name, stop_line): the evaluation at which patience ran out or the loss wasn't finite; null if training goes on."""
    e = lines(metrics).where(F.col("record_type") == "eval").select("run_name", "line_no", "val_loss")
    runs = e.groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct("line_no", "val_loss"))).alias("r"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def step(a: Column, v: Column) -> Column:
        x = v["val_loss"]
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        better = finite & (x < a["best"] - min_delta)
        bad = F.when(better, F.lit(0)).otherwise(a["bad"] + 1)
        stop = F.coalesce(a["stop"], F.when(~finite | (bad >= patience), v["line_no"]))
        return F.struct(F.when(better, x).otherwise(a["best"]).alias("best"), bad.alias("bad"), stop.alias("stop"))

    return runs.select("run_name", F.aggregate("r", start, step, lambda a: a["stop"]).alias("stop_line"))


def alerts(metrics: DataFrame) -> DataFrame:
    """(run_name, line_no, alert): every line at which the last lines of its run look wrong.

    gradient: a norm above 10 among the last three; loss: the last losses (up to three) from step 200 on all above 7; rate: a
    learning rate of 0 in the last ones (up to three) after step 20; overfitting: a gap of validation and training loss above
    0.5 and wider than two evaluations before; stagnation: five validation losses within 0.001. Lines without the value don't count.
    """
    s = lines(metrics)
    names = {"g": "grad_norm", "x": "train_loss", "r": "lr", "v": "val_loss", "t": "eval_train_loss"}
    s = s.select("run_name", "line_no", "step", "record_type", *(nan_free(c).alias(k) for k, c in names.items()))
    step, evals = s.where("record_type = 'step'"), s.where("record_type = 'eval' and v is not null")

    def last(n: int):
        return Window.partitionBy("run_name").orderBy("line_no").rowsBetween(1 - n, 0)

    found = {
        "gradient": step.where("g is not null").withColumn("hit", F.max("g").over(last(3)) > 10),
        "loss": step.where("x is not null and step >= 200").withColumn("hit", F.min("x").over(last(3)) > 7),
        "rate": step.where("r is not null").withColumn("hit", (F.col("step") > 20) & (F.max(F.abs("r")).over(last(3)) == 0)),
        "overfitting": evals.where("t is not null").withColumn("gap", F.col("v") - F.col("t")).withColumn("hit", (F.col("gap") > 0.5) & (F.col("gap") > F.lag("gap", 2).over(Window.partitionBy("run_name").orderBy("line_no")))),
        "stagnation": evals.withColumn("hit", (F.count("v").over(last(5)) == 5) & (F.max("v").over(last(5)) - F.min("v").over(last(5)) < 0.001)),
    }
    out = None
    for name, d in found.items():
        d = d.where("hit").select("run_name", "line_no", F.lit(name).alias("alert"))
        out = d if out is None else out.union(d)
    return out


def curve(points: DataFrame, width: int = 50, height: int = 8) -> DataFrame:
    """(x, y) cells of a grid that a curve of (step, loss) goes through; y 0 is the least loss. Null and NaN points are left out.

    A flat curve lies at the bottom.
    """
    p = points.select("step", nan_free("loss").alias("loss")).where("step is not null and loss is not null")
    ends = p.agg(F.min("step").alias("s0"), F.max("step").alias("s1"), F.min("loss").alias("l0"), F.max("loss").alias("l1"))
    p = p.crossJoin(F.broadcast(ends))  # a single row
    x = F.floor((F.col("step") - F.col("s0")) / F.greatest(F.col("s1") - F.col("s0"), F.lit(1)) * (width - 1))
    y = F.floor((F.col("loss") - F.col("l0")) / F.when(F.col("l1") == F.col("l0"), F.lit(1.0)).otherwise(F.col("l1") - F.col("l0")) * (height - 1))
    return p.select(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")).distinct()


def step_of(name: Column) -> Column:
    """Step in a checkpoint's file name: step_000123 or step123; null without."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"step_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"step(\d+)", 1), F.lit(""))).cast("bigint")


def _once(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.dropDuplicates(["run_name", "ckpt_name"]).withColumn("at", F.coalesce("step", step_of(F.col("ckpt_name"))))


def last_n(checkpoints: DataFrame, n: int = 3) -> DataFrame:
    """(run_name, step, ckpt_name): the n last of each run's 'last' checkpoints by step and name."""
    c = _once(checkpoints).where(F.col("ckpt_kind") == "last")
    rank = F.row_number().over(Window.partitionBy("run_name").orderBy(F.desc("at"), F.desc("ckpt_name")))
    return c.withColumn("k", rank).where(F.col("k") <= n).select("run_name", F.col("at").alias("step"), "ckpt_name")


def best_n(metrics: DataFrame, n: int = 2) -> DataFrame:
    """(run_name, step, val_loss): the n evaluations of least finite loss; ties by step."""
    e = eval_points(metrics).where(F.col("val_loss").isNotNull() & (F.abs("val_loss") < float("inf")))
    rank = F.row_number().over(Window.partitionBy("run_name").orderBy("val_loss", "step", "line_no"))
    return e.withColumn("k", rank).where(F.col("k") <= n).select("run_name", "step", "val_loss")


def retained_best(evaluations: DataFrame, n: int = 2) -> DataFrame:
    """(run_name, line_no, step, kept): for each evaluation in arrival order (line_no) whether its checkpoint is written at all.

    It isn't if the loss is null or not finite, or if n are held and it is no less than the worst of them. What is held at the
    end are the n least. The n least so far are all that is carried from line to line.
    """
    finite = F.col("val_loss").isNotNull() & ~F.isnan("val_loss") & (F.abs("val_loss") < float("inf"))
    e = evaluations.select("run_name", "line_no", "step", F.when(finite, F.col("val_loss")).alias("x"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("line_no")
        held, kept = [], []
        for x in t.column("x").to_pylist():
            ok = x is not None and (len(held) < n or x < held[-1])
            if ok:
                held = sorted([*held, x])[:n]
            kept.append(ok)
        return t.select(["run_name", "line_no", "step"]).append_column("kept", pa.array(kept))

    return e.groupBy("run_name").applyInArrow(fold, "run_name string, line_no bigint, step bigint, kept boolean")


def listed(checkpoints: DataFrame) -> DataFrame:
    """(run_name, ckpt_name, mtime): checkpoint files, the newest first; ties by name."""
    return _once(checkpoints).where(is_checkpoint(F.col("ckpt_name"))).select("run_name", "ckpt_name", "mtime").orderBy(F.desc_nulls_last("mtime"), "run_name", "ckpt_name")


def is_checkpoint(name: Column) -> Column:
    """Whether a file's name may be a checkpoint's: *.pt, or the older form."""
    return name.endswith(".pt") | name.rlike(C.OLD_CHECKPOINT)


def checkpoint_name(kind: Column, epoch: Column, step: Column) -> Column:
    return F.format_string("%s_epoch_%04d_step_%07d.pt", kind, epoch, step)


def run_folder(at: Column, tag: str | None = None) -> Column:
    """run_yyyymmdd_hhmmss, with _tag if there is one; in the session's time zone."""
    name = F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    return F.concat(name, F.lit(f"_{tag}")) if tag else name


def latest(checkpoints: DataFrame, validate: bool = True) -> DataFrame:
    """One row (run_name, ckpt_name, step): of the newest run by name that has a valid one, the checkpoint of highest step; 'last' before others, then the newest file."""
    c = _once(checkpoints)
    if validate:
        c = c.where("is_valid")
    return c.orderBy(F.desc("run_name"), F.desc_nulls_last("at"), F.desc(F.col("ckpt_kind") == "last"), F.desc("mtime"), "ckpt_name").limit(1).select("run_name", "ckpt_name", F.col("at").alias("step"))


def batch_perplexity(losses: DataFrame, most: int | None = None) -> DataFrame:
    """(loss, perplexity) as the mean of the means of batches; with `most`, of the first ones; losses: batch_id, loss."""
    m = losses.groupBy("batch_id").agg(F.avg("loss").alias("m"))
    m = (m.orderBy("batch_id").limit(most) if most is not None else m).agg(F.avg("m").alias("loss"))
    return m.select(F.round("loss", 6).alias("loss"), F.round(F.exp("loss"), 6).alias("perplexity"))


def upsert_ranking(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both, a new one replacing an old one of the same key, with their rank by value."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = rows.groupBy(key).agg(F.max_by(F.struct(*old.columns), "_new").alias("r")).select("r.*")
    return pick.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last(value), key)))
