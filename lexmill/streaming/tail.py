"""Structured Streaming: metric logs as they grow, curation of arriving documents, early stopping with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill import config as C
from lexmill.operators import decontaminate, status
from lexmill.sources.files import METRICS
from lexmill.plans.stage import semi_join


def metric_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """JSON lines of a folder as a stream; malformed and blank ones are left out."""
    s = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    parsed = s.select(F.from_json("value", METRICS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return parsed.where("m is not null and m._bad is null and m.type is not null").select("m.*").drop("_bad").withColumn("at", F.to_timestamp("timestamp"))


def windowed_loss(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, stage, n, mean_loss) of the step lines by event time; what comes later than `late` is left out."""
    s = stream.where("type = 'step'").withWatermark("at", late)
    return s.groupBy(F.window("at", width).alias("w"), "stage").agg(F.count("*").alias("n"), F.avg("train_loss").alias("mean_loss")).select(F.col("w.start").alias("start"), "stage", "n", "mean_loss")


def curated(stream: DataFrame, config: C.Config | None = None) -> DataFrame:
    """Arriving documents (doc_id, text, lang) with the phase that drops them; every phase is row-wise, so no state is kept."""
    return status.verdicts(stream, config)


def curate(stream: DataFrame, index: DataFrame, out: str, checkpoint: str, config: C.Config | None = None):
    """Write the kept documents of each micro-batch that aren't in the index of held-out fingerprints; running query."""

    def batch(df: DataFrame, number: int) -> None:
        kept = status.verdicts(df, config).where("phase = 'kept'").select("doc_id")
        fp = decontaminate.fingerprints(df)
        leaked = semi_join(fp, index, ["fp"]).select("doc_id")
        df.join(kept, "doc_id").join(leaked, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def early_stops(stream: DataFrame, patience: int = 3) -> DataFrame:
    """(stage, step): the evaluation at which a stage's patience ran out, once. State: least loss, bad evaluations, done."""

    def update(key, batches, state: GroupState):
        best, bad, done = state.get if state.exists else (float("inf"), 0, False)
        for b in batches:
            for step, loss in b.sort_values("at")[["step", "val_loss"]].itertuples(index=False):
                if done:
                    continue
                best, bad = (loss, 0) if loss < best else (best, bad + 1)
                if bad >= patience or loss != loss:
                    done = True
                    yield pd.DataFrame({"stage": [key[0]], "step": [int(step)]})
        state.update((best, bad, done))

    e = stream.where("type = 'eval' and step is not null").select("stage", "step", "val_loss", "at")
    return e.groupBy("stage").applyInPandasWithState(update, "stage string, step bigint", "best double, bad int, done boolean", "append", GroupStateTimeout.NoTimeout)
