"""Stage boundaries: reliable checkpoints and size-gated joins."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that may be broadcast (two longs each at most, so some 10 MB); larger sets are joined by shuffle.
BROADCAST_ROWS = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Only on a single machine, as in tests, a temporary one serves where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexmill-ckpt-"))


def drop_checkpoints(spark: SparkSession) -> None:
    """Remove everything this session has checkpointed; frames that rest on it can't be read any more."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_released = 0.0


def release(spark: SparkSession, every: float = 3.0) -> None:
    """Let Spark remove the shuffle files of frames that nobody holds any more, at most once in `every` seconds.

    Its cleaner waits for the garbage collector of the driver, which may not run for hours while the executors' disks fill.
    """
    global _released
    if time.monotonic() - _released >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives the loss of executors. What earlier cuts have shuffled is released."""
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS, weight: str = "1") -> DataFrame:
    """Inner join of df with a cut frame of unique keys: broadcast if it has at most `limit` rows, else shuffled.

    Rows that hold more than a value or two give their number of values by the SQL expression `weight`.
    """
    small = (keys.selectExpr(f"sum({weight}) n").first().n or 0) <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_merge"), on)


def left_join(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of df with a frame of unique keys that rests on a cut one, by the same rule."""
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_merge"), on, "left")


def anti_join(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df without a row in a cut frame of keys, by the same rule."""
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_merge"), on, "left_anti")


#: Rows of df for one key from which on a key is hot.
HEAVY = 50_000


def split_join(df: DataFrame, keys: DataFrame, on: list[str], n: str = "n", limit: int = BROADCAST_ROWS, heavy: int = HEAVY) -> DataFrame:
    """Inner join of df with a cut frame of unique keys that tells in n how many rows of df each has; n is dropped.

    Broadcast if there are at most `limit` keys. Else the hot ones, of which there are few, are broadcast and their rows stay
    where they are, and only the rest is shuffled; so no task gets a hot key's rows.
    """
    if keys.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(keys.drop(n)), on)
    hot = keys.where(F.col(n) >= heavy).drop(n)
    while hot.limit(limit + 1).count() > limit:  # then they aren't few, and less hot ones can be shuffled
        heavy *= 4
        hot = keys.where(F.col(n) >= heavy).drop(n)
    cold = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col(n) < heavy).drop(n).hint("shuffle_merge"), on)
    return df.join(F.broadcast(hot), on).unionByName(cold)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer partitions than these, as a single small file is, is dealt out anew; larger ones stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
