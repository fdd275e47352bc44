"""The texts that models are fitted on, drawn in one pass over the records."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_batches
from lexmill.plans.stage import cut


class Drawn:
    """The records of the given ids, and of each kind the `k` texts of least hash among the distinct ones of all records.

    kinds: name -> test of (text, lower-cased text). A task keeps at most k texts of each kind, so what is written and what
    comes to the driver is bounded whatever the records are; a text in many records counts once. Null and empty texts are no one's.
    """

    def __init__(self, records: DataFrame, ids: set[int], kinds: dict[str, Callable[[str, str], bool]], k: int):
        wanted = records.sparkSession.sparkContext.broadcast(ids)
        names = list(kinds)
        self.k = k

        def run(batches):
            best: list[dict[int, str]] = [{} for _ in names]
            edge = [1 << 64] * len(names)

            def trim(j: int, most: int) -> None:
                if len(best[j]) > most:
                    keep = heapq.nsmallest(k, best[j])
                    best[j], edge[j] = {h: best[j][h] for h in keep}, keep[-1]

            for rows, texts in text_batches(batches, "row_id", "text"):
                mine = [(i, t) for i, t in zip(rows, texts) if i in wanted.value and t]
                if mine:
                    yield pa.RecordBatch.from_arrays([pa.array(["id"] * len(mine)), pa.array([i for i, _ in mine], pa.int64()), pa.array([0] * len(mine), pa.int64()), pa.array([t for _, t in mine])], names=["kind", "row_id", "key", "text"])
                for t in texts:
                    if not t:
                        continue
                    h, low = xxhash.xxh3_64_intdigest(t), None
                    for j, name in enumerate(names):
                        if h < edge[j] and h not in best[j]:
                            low = t.lower() if low is None else low
                            if kinds[name](t, low):
                                best[j][h] = t
                                trim(j, 2 * k)
            for j, name in enumerate(names):
                trim(j, k)
                rows_ = sorted(best[j].items())
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows_)), pa.array([None] * len(rows_), pa.int64()), pa.array([h - (1 << 63) for h, _ in rows_], pa.int64()), pa.array([t for _, t in rows_])], names=["kind", "row_id", "key", "text"])

        self.rows = cut(records.select("row_id", "text").mapInArrow(run, "kind string, row_id bigint, key bigint, text string"))

    def records(self) -> DataFrame:
        """(row_id, text) of the given ids."""
        return self.rows.where("kind = 'id'").select("row_id", "text")

    def texts(self, kind: str) -> list[str]:
        """At most k texts of a kind, in the order of their hash."""
        return [r.text for r in self.rows.where(F.col("kind") == kind).groupBy("key").agg(F.min("text").alias("text")).orderBy("key").limit(self.k).collect()]
