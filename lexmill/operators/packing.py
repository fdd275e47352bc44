"""Token streams: lengths, offsets, split and fixed-length chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.plans.prefix import running_total


def word_lengths(df: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) with words as tokens and one end mark."""
    return df.select("doc_id", (F.size(T.words(T.text(F.col("text")))) + 1).cast("bigint").alias("n_tokens"))


def tokenize(df: DataFrame, path: str | None = None, end: int = 50256) -> DataFrame:
    """(doc_id, input_ids, n_tokens) of a byte-level vocabulary, an end mark after each document; the file is read once a task."""

    def run(batches):
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        for b in batches:
            ids = [[*e.ids, end] for e in t.encode_batch(b["text"].fillna("").tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "input_ids": ids, "n_tokens": [len(x) for x in ids]})

    return df.select("doc_id", "text").mapInPandas(run, "doc_id bigint, input_ids array<int>, n_tokens int")


def offsets(lengths: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, start): place of each document in the stream, in the order of the ids."""
    return running_total(lengths, "doc_id", "n_tokens", "start").select("doc_id", "n_tokens", F.col("start").cast("bigint").alias("start"))


def total_tokens(lengths: DataFrame) -> int:
    return lengths.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def val_tokens(total: int, ratio: float) -> int:
    return min(total, max(1, int(total * ratio)))


def split(lengths: DataFrame, config: C.Config | None = None) -> DataFrame:
    """(split, n_tokens, n_kept, n_chunks): the first tokens are val; each split is trimmed to whole chunks of context_length + 1."""
    config = config or C.Config()
    total, size = total_tokens(lengths), config.context_length + 1
    val = val_tokens(total, config.val_ratio)
    rows = [(name, n, n // size * size, n // size) for name, n in (("train", total - val), ("val", val))]
    return lengths.sparkSession.createDataFrame(rows, "split string, n_tokens bigint, n_kept bigint, n_chunks bigint")


def chunks(lengths: DataFrame, config: C.Config | None = None) -> DataFrame:
    """(split, chunk, first_doc, last_doc, n_docs) of every whole chunk. A document is exploded to the chunks it reaches, never to tokens."""
    config = config or C.Config()
    size, total = config.context_length + 1, total_tokens(lengths)
    val = val_tokens(total, config.val_ratio)
    d = offsets(lengths).withColumn("end", F.col("start") + F.col("n_tokens"))
    parts = []
    for name, lo, hi in (("val", 0, val), ("train", val, total)):
        n = (hi - lo) // size
        s = d.where((F.col("end") > lo) & (F.col("start") < lo + n * size) & (F.col("n_tokens") > 0))
        first = F.floor(F.greatest(F.col("start") - lo, F.lit(0)) / size)
        last = F.floor((F.least(F.col("end"), F.lit(lo + n * size)) - 1 - lo) / size)
        parts.append(s.select(F.lit(name).alias("split"), "doc_id", F.explode(F.sequence(first, last)).alias("chunk")))
    return parts[0].union(parts[1]).groupBy("split", "chunk").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"))


def eval_windows(spark, n_tokens: int, context: int, most: int) -> DataFrame:
    """(window, start, n_targets): windows of `context` tokens and the one after, at stride `context`."""
    n = min(most, max(0, -(-(n_tokens - context) // context)))
    w = spark.range(n).select(F.col("id").alias("window"), (F.col("id") * context).alias("start"))
    return w.withColumn("n_targets", F.lit(context).cast("bigint"))


def cutoffs(lengths: DataFrame, limits=(16, 32, 64, 128, 256, 512, 1024)) -> DataFrame:
    """(min_tokens, dropped, kept, coverage): what each least length would cost; one pass with an aggregate for each limit."""
    n = F.col("n_tokens")
    aggs = [F.struct(F.lit(k).alias("min_tokens"), F.count_if(n < k).alias("dropped"), F.count_if(n >= k).alias("kept"), F.round(100 * F.coalesce(F.sum(F.when(n >= k, n)), F.lit(0)) / F.sum(n), 6).alias("coverage")) for k in limits]
    return lengths.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def histogram(lengths: DataFrame, edges=(0, 32, 64, 128, 256, 512, 1024)) -> DataFrame:
    """(bin, n_docs) for lengths in (lo, hi]; the last bin is open."""
    n, c = F.col("n_tokens"), None
    for lo, hi in zip(edges, [*edges[1:], None]):
        hit = (n > lo) & (n <= hi) if hi else n > lo
        c = F.when(hit, f"({lo},{hi or 'inf'}]") if c is None else c.when(hit, f"({lo},{hi or 'inf'}]")
    return lengths.select(c.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_docs"))
