"""Readers: corpora, metric logs, text logs, token files, configs."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill import config as C

METRICS = "stage string, type string, timestamp string, step bigint, epoch int, train_loss double, perplexity double, lr double, grad_norm double, tokens_per_sec double, val_loss double, val_ppl double, eval_train_loss double, eval_train_ppl double"

# The lines of a text log that carry numbers.
STEP_LINE = r"step\s+(\d+)\s*\|.*?loss\s+([\d.]+)\s*\|.*?lr\s+([\d.e+-]+)\s*\|.*?grad\s+([\d.]+)"
PPL_LINE = r"step\s+(\d+)\s*\|\s*ppl\s+([\d.]+)"
TRAIN_LINE = r"Train:\s*loss=([\d.]+),\s*ppl=([\d.]+)"
VAL_LINE = r"Val:\s*loss=([\d.]+),\s*ppl=([\d.]+)"
BEST_LINE = r"\*\* New best validation loss! \*\*"
EVAL_LINE = r"Starting evaluation\.\.\."


def corpus(spark: SparkSession, root: str, size: str = "full", names: dict[str, str] | None = None) -> DataFrame:
    """A saved corpus by size; a missing one is an error."""
    names = names or {"small": "openwebtext_10k", "dummy": "openwebtext_100", "full": "documents"}
    if size not in names:
        raise ValueError(f"size {size!r} is none of {sorted(names)}")
    return spark.read.parquet(f"{root}/{names[size]}.parquet")


def held_out(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(item_id, text, split_name) of all splits by name -> path; a missing one is warned of and left out, none at all is an error."""
    found = None
    for name, path in sorted(paths.items()):
        try:
            d = spark.read.parquet(path).select("item_id", "text", F.lit(name).alias("split_name"))
        except AnalysisException:
            warnings.warn(f"no held-out split {name!r} at {path}", stacklevel=2)
            continue
        found = d if found is None else found.unionByName(d)
    if found is None:
        raise FileNotFoundError("none of the held-out splits is there")
    return found


def cached_subset(spark: SparkSession, root: str, tokens: int, seed: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The subset for a token budget and seed: read if it was written before, else made and written in files of SHARD_DOCS rows."""
    path = f"{root}/subset-{tokens}-seed{seed}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").option("maxRecordsPerFile", C.SHARD_DOCS).parquet(path)
    return spark.read.parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a file is one run's log and so bounded."""
    b = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n")
    return b.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, METRICS...) of JSON lines; blank and malformed ones are left out."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = rows.select("file", "line_no", F.from_json("line", METRICS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return parsed.where("m is not null and m._bad is null and m.type is not null").select("file", "line_no", "m.*").drop("_bad")


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, type, step, loss, lr, grad_norm, perplexity) of a text log; evaluations carry the step before them.

    type is step, perplexity, eval_train, eval or best_checkpoint. Train and Val lines count only inside an evaluation,
    which begins with its start line and ends with the next step.
    """
    r = numbered_lines(spark, path)
    got = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit("")).cast("double")
    r = r.withColumn("type", F.when(F.col("line").rlike(STEP_LINE), "step").when(F.col("line").rlike(PPL_LINE), "perplexity").when(F.col("line").rlike(EVAL_LINE), "start").when(F.col("line").rlike(TRAIN_LINE), "eval_train").when(F.col("line").rlike(VAL_LINE), "eval").when(F.col("line").rlike(BEST_LINE), "best_checkpoint"))
    r = r.where("type is not null")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("step", F.last(F.when(F.col("type") == "step", got(STEP_LINE, 1)), ignorenulls=True).over(w).cast("bigint"))
    r = r.withColumn("inside", F.last(F.when(F.col("type") == "start", True).when(F.col("type") == "step", False), ignorenulls=True).over(w))
    kept = r.where("type in ('step', 'perplexity') or (type <> 'start' and inside)")
    loss = F.coalesce(got(STEP_LINE, 2), got(TRAIN_LINE, 1), got(VAL_LINE, 1))
    return kept.select("file", "line_no", "type", "step", loss.alias("loss"), got(STEP_LINE, 3).alias("lr"), got(STEP_LINE, 4).alias("grad_norm"), F.coalesce(got(PPL_LINE, 2), got(TRAIN_LINE, 2), got(VAL_LINE, 2)).alias("perplexity"))


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """metrics.jsonl of a run's folder if it is there, else train.log, else an error."""
    if os.path.exists(f"{folder}/metrics.jsonl"):
        return metrics(spark, f"{folder}/metrics.jsonl")
    if os.path.exists(f"{folder}/train.log"):
        return text_log(spark, f"{folder}/train.log")
    raise FileNotFoundError(f"{folder} has neither metrics.jsonl nor train.log")


def run_label(folder: str) -> str:
    """Label of a run from its config.json, '?' for what is missing; the folder's name without a readable one."""
    try:
        with open(f"{folder}/config.json", encoding="utf-8") as f:
            c = json.load(f)
        t, m = c.get("training", {}), c.get("model", {})
        return f"lr={t.get('learning_rate', '?')}, layers={m.get('n_layers', '?')}, d={m.get('d_model', '?')}"
    except (OSError, ValueError, AttributeError):
        return os.path.basename(folder.rstrip("/"))


def config_file(path: str) -> dict:
    """A YAML mapping; missing, empty or other files are errors."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not got:
        raise ValueError(f"{path} is empty")
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def token_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(chunk, input_ids) of a headless file of 16-bit tokens in the shared folder; tasks map their own slices, a rest under `size` tokens is left out."""
    n = os.path.getsize(path) // 2 // size

    def run(batches):
        tokens = np.memmap(path, np.uint16, "r") if n else None
        for b in batches:
            yield pd.DataFrame({"chunk": b["id"], "input_ids": [tokens[i * size : (i + 1) * size].astype(np.int32) for i in b["id"]]})

    return spark.range(n).mapInPandas(run, "chunk bigint, input_ids array<int>")


def windows(chunks: DataFrame) -> DataFrame:
    """(chunk, x, y): inputs and targets of each chunk, one token apart."""
    n = F.size("input_ids")
    return chunks.select("chunk", F.slice("input_ids", F.lit(1), n - 1).alias("x"), F.slice("input_ids", F.lit(2), n - 1).alias("y"))
