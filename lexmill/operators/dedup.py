"""Deduplication: exact by fingerprint, near by min-hash bands and connected components, without looking at the similarity, or
by links whose similarity is verified; the pipeline uses the latter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.python import nfc
from lexmill.plans.components import components
from lexmill.plans.stage import anti_join, cut, split_join


def exact_clusters(df: DataFrame) -> DataFrame:
    """(fp, n_docs, first_id) of texts that stand in two documents or more, after NFC, lower case and single blanks."""
    n = T.strip(F.regexp_replace(F.lower(nfc(T.text(F.col("text")))), f"[{T.SPACE}]+", " "))
    return df.select("doc_id", F.sha1(F.encode(n, "utf-8")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")).where("n_docs > 1")


def shingle_hashes(c: Column, n: int = C.SHINGLE) -> Column:
    """Distinct 28-bit hashes of the runs of n lower-cased words; empty with fewer words."""

    def hashes(w: Column) -> Column:
        one = lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(w, i, n), " ").cast("binary")), 1, 7), 16, 10).cast("long")
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), one)
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return T.let(T.words(F.lower(T.text(c))), hashes)


def signatures(df: DataFrame) -> DataFrame:
    """(doc_id, sig): least value of each hash function; a document without shingles has EMPTY_HASH throughout. Row by row, no shuffle."""

    def least(h: Column, a: int, b: int) -> Column:
        return F.coalesce(F.array_min(F.transform(h, lambda x: (x * a + b) % C.PRIME)), F.lit(C.EMPTY_HASH))

    return df.select("doc_id", T.let(shingle_hashes(F.col("text")), lambda h: F.array(*(least(h, a, b) for a, b in C.HASHES))).alias("sig"))


def buckets(sig: DataFrame) -> DataFrame:
    """(doc_id, band, key): the bands of each signature."""
    rows = C.PERMUTATIONS // C.BANDS
    keys = F.array(*(F.struct(F.lit(k).cast("bigint").alias("band"), F.array_join(F.slice("sig", k * rows + 1, rows).cast("array<string>"), "-").alias("key")) for k in range(C.BANDS)))
    return sig.select("doc_id", F.explode(keys).alias("b")).select("doc_id", "b.band", "b.key")


def links(df: DataFrame) -> DataFrame:
    """(a, b): the least document of each bucket with every other one; stars, not pairs. Counted before the shuffle, hot buckets aren't shuffled.

    Documents without shingles have equal signatures, so are in all buckets together: they are one star, apart from the rest.
    """
    sig = cut(signatures(df))
    none = F.col("sig")[0] == C.EMPTY_HASH
    empty = sig.where(none).select("doc_id")
    star = empty.crossJoin(F.broadcast(empty.agg(F.min("doc_id").alias("a")))).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))  # with a single row
    b = cut(buckets(sig.where(~none)))
    first = cut(b.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    return split_join(b, first, ["band", "key"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b")).union(star).distinct()


def clusters(df: DataFrame) -> DataFrame:
    """(doc_id, cluster) of every document in a cluster of two or more."""
    return components(links(df)).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))


def survivors(df: DataFrame) -> DataFrame:
    """Documents without the later members of clusters."""
    return anti_join(df, cut(clusters(df).where("doc_id <> cluster").select("doc_id")), ["doc_id"])


def estimated_similarity(df: DataFrame) -> DataFrame:
    """(a, b, similarity): share of equal places of the signatures of linked documents; 0 for documents without shingles."""
    s = signatures(df)
    e = links(df)
    both = e.join(s.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda a, v: a + v)
    none = F.col("x")[0] == C.EMPTY_HASH
    return both.select("a", "b", F.when(none, F.lit(0.0)).otherwise(same / C.PERMUTATIONS).alias("similarity"))


#: Documents whose shingles are counted to tell common ones, and how many common ones are sent to the executors.
COUNTED, COMMON = 20_000, 100_000
#: Keys that similar sets must share; of sets with fewer shingles in common, all of them.
MATCHES = 6


def shingle_sets(df: DataFrame) -> DataFrame:
    """(doc_id, n, h): the n distinct 64-bit hashes of the runs of SHINGLE lower-cased words, sorted; of shorter texts of all words, blank ones are left out."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - C.SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, C.SHINGLE)))
        return F.array_sort(F.array_distinct(F.when(F.size(w) >= C.SHINGLE, runs).otherwise(F.array(F.xxhash64(w)))))

    filled = df.select("doc_id", T.words(F.lower(T.text(F.col("text")))).alias("w")).where(F.size("w") > 0)
    return filled.select("doc_id", T.let(F.col("w"), hashes).alias("h")).select("doc_id", F.size("h").alias("n"), "h")


def similar(df: DataFrame, least: float = C.SIMILAR) -> DataFrame:
    """(a, b, similarity), a < b: documents whose shingle sets have a Jaccard similarity of `least` or more; each is verified and none is lost.

    Equal sets are stars around their least document; the other pairs are between these. Two sets that similar have k of
    their first n - ceil(least * n) + k shingles in common in any order; here common ones come last, so that they are no keys.
    """
    s = cut(shingle_sets(df))
    same = [F.xxhash64("h").alias("x"), F.xxhash64(F.reverse("h")).alias("y"), F.col("n")]
    first = cut(s.groupBy(*same).agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k"))
    copies = cut(s.select("doc_id", *same).join(first, ["x", "y", "n"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    reps = anti_join(s, copies.select(F.col("b").alias("doc_id")), ["doc_id"])
    part = reps.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, reps.count() // COUNTED))) == 0)
    top = part.select(F.explode("h").alias("key")).groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(COMMON).toPandas()
    rows = reps.select("doc_id", "n", "h").mapInArrow(_prefixes(df.sparkSession.sparkContext.broadcast(top.sort_values("key").to_numpy(np.int64)), least), "doc_id bigint, n int, key bigint, place int")
    rows = cut(rows)
    a = rows.select("key", F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("place").alias("i"))
    b = rows.select("key", F.col("doc_id").alias("b"), "n", F.col("place").alias("j"))
    # In common are this one, and at most what stands before it in both orders and after it in both.
    most = F.least("i", "j") + 1 + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) - 1
    near = (F.col("a") < F.col("b")) & (most >= (F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-9)
    must = F.least(F.lit(MATCHES), F.ceil(F.greatest("m", "n") * least - 1e-9))
    pairs = cut(a.join(b, "key").where(near).groupBy("a", "b", must.alias("must")).agg(F.countDistinct("key").alias("k")).where("k >= must").select("a", "b"))
    both = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("h").alias("h_a")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("h").alias("h_b")), "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    both = both.select("a", "b", (common / (F.size("h_a") + F.size("h_b") - common)).alias("similarity")).where(F.col("similarity") >= least)
    return copies.select("a", "b", F.lit(1.0).alias("similarity")).union(both)


def _prefixes(common, least: float):
    """Arrow function (doc_id, n, h) -> (doc_id, n, key, place): as many shingles as a similar set must share MATCHES of; rare ones first, then by hash."""

    def run(batches):
        keys, counts = common.value[:, 0], common.value[:, 1]
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            h = batch.column(2).flatten().to_numpy()
            seen = np.zeros(len(h), np.int64)
            if len(keys):
                at = np.searchsorted(keys, h).clip(0, len(keys) - 1)
                seen = np.where(keys[at] == h, counts[at], 0)
            own = np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((h, seen, own))
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            taken = place < np.repeat(sizes - np.ceil(sizes * least - 1e-9).astype(np.int64) + MATCHES, sizes)
            own = own[taken]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(sizes[own]), pa.array(h[order[taken]]), pa.array(place[taken].astype(np.int32))], names=["doc_id", "n", "key", "place"])

    return run


def verified_survivors(df: DataFrame, least: float = C.SIMILAR) -> DataFrame:
    """Documents without the later members of the components of verified links."""
    parts = components(similar(df, least))
    return anti_join(df, cut(parts.where("id <> component").select(F.col("id").alias("doc_id"))), ["doc_id"])
