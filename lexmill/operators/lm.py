"""Relational unigram language model: coherence of documents as mean log probability of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.plans.stage import cut, split_join


def word_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode(F.regexp_extract_all(F.lower(T.text(F.col("text"))), F.lit("[a-z']+"), F.lit(0))).alias("word"))


def unigram_scores(df: DataFrame) -> DataFrame:
    """(doc_id, log_prob): mean of log((count + 1) / (N + V)) over the words; without words -20.

    Words are counted per document first, so that the join with the vocabulary moves one row for each distinct word of a
    document; rows of words that are in very many documents aren't moved.
    """
    per = word_rows(df).groupBy("doc_id", "word").agg(F.count("*").alias("k"))
    vocab = cut(per.groupBy("word").agg(F.sum("k").alias("c"), F.count("*").alias("n")))
    size = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("v")).first()
    p = vocab.select("word", "n", F.log((F.col("c") + 1) / F.lit(float(size.total + size.v))).alias("lp"))
    mean = split_join(per, p, ["word"]).groupBy("doc_id").agg((F.sum(F.col("lp") * F.col("k")) / F.sum("k")).alias("m"))
    return df.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.round(F.coalesce("m", F.lit(C.NO_WORDS_LOG_PROB)), 6).alias("log_prob"))


def training_lines(df: DataFrame, most: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, line): a line for each document, blank ones left out; with `most`, those of least key."""
    s = df.select(key, T.strip(F.replace(T.text(F.col("text")), F.lit("\n"), F.lit(" "))).alias("line")).where("line <> ''")
    return s.orderBy(key).limit(most) if most is not None else s


def ngram_counts(texts: DataFrame, order: int = 3) -> DataFrame:
    """(n, gram, c, followers, kinds) of all runs of 1 to `order` words of (text), cut: how often each occurs, with how many words after it, and how many different ones; the model that perplexity() scores with.

    Counted within the task before the shuffle; a hot run is one row a task.
    """
    w = F.regexp_extract_all(F.lower(T.text(F.col("text"))), F.lit("[a-z']+"), F.lit(0))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
        return F.when(F.size("w") >= n, every).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    rows = texts.select(w.alias("w")).where(F.size("w") > 0).select(F.explode(F.concat(*map(runs, range(1, order + 1)))).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("c"))
    c = cut(rows)
    head = c.where("n > 1").groupBy((F.col("n") - 1).alias("n"), F.regexp_replace("gram", " [^ ]+$", "").alias("gram")).agg(F.sum("c").alias("followers"), F.count("*").alias("kinds"))
    return cut(c.join(head, ["n", "gram"], "left").fillna(0, ["followers", "kinds"]))


def perplexity(df: DataFrame, counts: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, perplexity) by the n-gram model `counts`, interpolated from the longest run down to single words (Witten-Bell); blank documents have infinity.

    p(w | h) = (c(h w) + kinds(h) * p(w | shorter h)) / (c(h) + kinds(h)); p(w) = (c(w) + 1) / (N + V + 1). Each distinct
    run of a document is looked up once; runs in very many documents aren't moved.
    """
    w = F.regexp_extract_all(F.lower(T.text(F.col("text"))), F.lit("[a-z']+"), F.lit(0))
    # For each word the run of up to `order` words that ends with it, how often it stands in the document.
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))), " "))
    runs = cut(df.select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", F.explode(ends).alias("run")).groupBy("doc_id", "run").agg(F.count("*").alias("k")))
    each = runs.groupBy("run").agg(F.count("*").alias("n"))
    total = counts.where("n = 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.count("*").alias("v")).first()
    parts = F.split("run", " ")
    need = each.select("run", "n", parts.alias("p"))
    gram = lambda m, end: F.when(F.size("p") >= m + end, F.array_join(F.slice("p", F.size("p") - m - end + 1, F.lit(m)), " "))
    asked = need.select("run", *(gram(m, 0).alias(f"g{m}") for m in range(1, order + 1)), *(gram(m, 1).alias(f"h{m}") for m in range(1, order)))
    for m in range(1, order + 1):
        asked = asked.join(counts.where(F.col("n") == m).select(F.col("gram").alias(f"g{m}"), F.col("c").alias(f"c{m}")), f"g{m}", "left")
    for m in range(1, order):
        asked = asked.join(counts.where(F.col("n") == m).select(F.col("gram").alias(f"h{m}"), F.col("followers").alias(f"f{m}"), F.col("kinds").alias(f"k{m}")), f"h{m}", "left")
    p = (F.coalesce("c1", F.lit(0)) + 1) / F.lit(float(total.t + total.v + 1))
    for m in range(1, order):
        known = F.coalesce(F.col(f"f{m}"), F.lit(0)) > 0
        p = F.when(known, (F.coalesce(F.col(f"c{m + 1}"), F.lit(0)) + F.col(f"k{m}") * p) / (F.col(f"f{m}") + F.col(f"k{m}"))).otherwise(p)
    lp = cut(asked.select("run", F.log(p).alias("lp")).join(each, "run"))
    mean = split_join(runs, lp, ["run"]).groupBy("doc_id").agg((F.sum(F.col("lp") * F.col("k")) / F.sum("k")).alias("m"))
    return df.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce(F.exp(-F.col("m")), F.lit(float("inf"))).alias("perplexity"))


def perplexity_status(df: DataFrame, low: float = 10.0, high: float = 100_000.0, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, perplexity, status): perplexity_outlier outside [low, high]; by the n-gram model `counts`, without one by the unigrams of df itself."""
    s = perplexity(df, counts) if counts is not None else unigram_scores(df).select("doc_id", F.exp(-F.col("log_prob")).alias("perplexity"))
    s = s.withColumn("perplexity", F.round("perplexity", 4))
    return s.select("doc_id", "perplexity", F.when((F.col("perplexity") < low) | (F.col("perplexity") > high), "perplexity_outlier").otherwise("kept").alias("status"))
