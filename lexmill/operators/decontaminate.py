"""Decontamination against held-out splits: fingerprints, and character runs in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.python import nfc
from lexmill.plans.stage import cut, left_join


def fingerprint(c: Column) -> Column:
    """SHA-1 of the normalized text, null if that is empty."""
    return T.let(T.normalize(nfc(c)), lambda n: F.when(n != "", F.sha1(F.encode(n, "utf-8"))))


def fingerprints(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) of each row."""
    return df.select(key, fingerprint(F.col("text")).alias("fp"))


def index_of(items: DataFrame) -> DataFrame:
    """Distinct fingerprints of the held-out items; checkpointed, joined by size."""
    return cut(fingerprints(items, "item_id").where(F.col("fp").isNotNull()).select("fp").distinct())


def status(df: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, fp, status): empty_after_normalize, test_overlap or kept."""
    rows = left_join(fingerprints(df), index_of(items).withColumn("hit", F.lit(True)), ["fp"])
    return rows.select("doc_id", "fp", F.when(F.col("fp").isNull(), "empty_after_normalize").when(F.col("hit"), "test_overlap").otherwise("kept").alias("status"))


#: Runs of characters of the held-out items that are sent to the executors (8 bytes each); more are joined by shuffle.
INDEX_RUNS = 2_000_000
#: Bits of the bitmap over the index in that case, as a power of 2.
BITMAP = 27


def char_runs(text: str, n: int = C.OVERLAP_CHARS) -> np.ndarray:
    """64-bit hashes of the distinct runs of n characters, sorted; none in shorter texts."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h + x[j : j + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def _plain(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, T.strip(F.lower(T.text(F.col("text")))).alias("t"))


def _runs(df: DataFrame, key: str, bitmap=None) -> DataFrame:
    """(key, g): the runs of each text; only those that the bitmap lets through if there is one."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = char_runs(t)
                if bitmap is not None:
                    at = (g.view(np.uint64) >> np.uint64(64 - BITMAP)).astype(np.int64)
                    g = g[(bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(g), pa.int64()), pa.array(g)], names=[key, "g"])

    return _plain(df, key).mapInArrow(run, f"{key} bigint, g bigint")


def _matches(df: DataFrame, index) -> DataFrame:
    """(doc_id, n_grams, n_matched) of each row; index: broadcast sorted runs, of which none is a match if it is empty."""

    def run(batches):
        known = index.value
        for b in batches:
            n, m = [], []
            for t in b.column(1).to_pylist():
                g = char_runs(t)
                n.append(len(g))
                m.append(int((known[np.searchsorted(known, g).clip(0, len(known) - 1)] == g).sum()) if len(known) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["doc_id", "n_grams", "n_matched"])

    return _plain(df, "doc_id").mapInArrow(run, "doc_id bigint, n_grams bigint, n_matched bigint")


def char_overlap(df: DataFrame, items: DataFrame, limit: int = INDEX_RUNS) -> DataFrame:
    """(doc_id, n_grams, n_matched, ratio, contaminated): distinct 13-character runs that also stand in an item; doc_id is unique.

    Runs are compared by 64-bit hash. Texts under 13 characters have none and are clean. With an index of up to `limit` runs the
    documents are one pass without a shuffle. Beyond, only runs that a bitmap of the index lets through are joined with it.
    """
    sc = df.sparkSession.sparkContext
    index = cut(_runs(items, "item_id").select("g").distinct())
    if index.limit(limit + 1).count() <= limit:
        rows = _matches(df, sc.broadcast(np.sort(index.toArrow().column(0).to_numpy())))
    else:
        bit = F.shiftrightunsigned("g", 64 - BITMAP)
        octets = index.groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(F.pow(F.lit(2), bit % 8).cast("int")).alias("bits")).toArrow()  # 2 ** (BITMAP - 3) rows at most
        bitmap = np.zeros(1 << (BITMAP - 3), np.uint8)
        bitmap[octets.column(0).to_numpy()] = octets.column(1).to_numpy()
        near = cut(_runs(df, "doc_id", sc.broadcast(bitmap)))
        # Two plain tables, so that adaptive execution can split a hot run.
        found = near.join(index.hint("shuffle_merge"), "g").groupBy("doc_id").agg(F.count("*").alias("found"))
        rows = _matches(df, sc.broadcast(np.zeros(0, np.int64))).join(found, "doc_id", "left").select("doc_id", "n_grams", F.coalesce("found", F.lit(0)).cast("bigint").alias("n_matched"))
    ratio = T.share(F.col("n_matched"), F.col("n_grams"))
    return rows.select("doc_id", "n_grams", "n_matched", F.round(ratio, 6).alias("ratio"), (ratio > C.MAX_OVERLAP).alias("contaminated"))
