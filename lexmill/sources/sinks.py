"""Writers: token files, training lines, metric lines, rankings, parameters."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import packing
from lexmill.plans.stage import cut


def token_file(tokens: DataFrame, path: str) -> int:
    """Write input_ids in the order of doc_id to a headless file of 16-bit tokens in the shared folder; the number of tokens.

    Each task writes its documents at their places of the whole, so nothing passes through the driver and a task that
    runs again writes the same bytes.
    """
    t = cut(tokens.select("doc_id", "input_ids", F.size("input_ids").cast("bigint").alias("n_tokens")))
    total = packing.total_tokens(t)
    with open(path, "wb") as f:
        f.truncate(2 * total)
    placed = t.join(packing.offsets(t).select("doc_id", "start"), "doc_id")

    def run(batches):
        with open(path, "r+b") as f:
            for b in batches:
                for ids, at in zip(b["input_ids"], b["start"]):
                    f.seek(2 * int(at))
                    f.write(np.asarray(ids, np.uint16).tobytes())
                yield pd.DataFrame({"n": [len(b)]})

    placed.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
    return total


def lines(df: DataFrame, column: str, path: str) -> None:
    """One line a row, blank ones left out."""
    df.select(F.trim(F.regexp_replace(column, "[\r\n]+", " ")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def best_params(params: dict, model_keys: set[str], path: str | None = None) -> dict:
    """Parameters split into model and training; unknown ones are training's. Written as YAML if a path is given."""
    out = {"model": {k: v for k, v in params.items() if k in model_keys}, "training": {k: v for k, v in params.items() if k not in model_keys}}
    if path:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(out, f, sort_keys=True)
    return out


def inside(root: str, name: str) -> str:
    """Path of a folder below root; absolute names and ones that lead out are errors."""
    path = os.path.realpath(os.path.join(root, name))
    if os.path.isabs(name) or not path.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{name!r} leads out of {root!r}")
    return path
