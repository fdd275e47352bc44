"""Problem 7: mixing sources to target weights, by Sainte-Lague apportionment.

The mix is as large as all documents whose source has a target. It is cut into blocks of equal tokens, and the blocks
go to the sources one after the other by the highest quotient share / (2 * blocks so far + 1); a source leaves the
contest when its blocks reach its tokens times max_repeats. A source's blocks are then divided over SHARDS shards (by a
seeded hash of the document id) by the same rule, with what each shard holds as weight. Within a source and shard,
whole documents are taken in seeded order until the quota is filled: all of them as often as the quota holds the
shard's tokens, and one time more up to the document nearest to the rest.

A source is unreachable if a contest with blocks of one token, which nobody leaves, gives it more than its tokens times
max_repeats: there it would have gone on winning blocks after its last document.

Sizes are tokens of a public tokenizer, counted in Python once and cut. Only the totals of the shards come to the driver
(SHARDS rows a target). The documents of a shard fall into BUCKETS buckets in seeded order; whole buckets are taken by
their totals, and only the one in which the rest ends is ranked, so that no source or shard is sorted in one task.

Sources are compared after lower-casing and trimming. Documents with a null source or one without a target stay out;
null and empty texts have no tokens. A null or non-positive target_share asks for nothing. Of repeated targets the
first in the order (target_share, max_repeats) counts. A repeated doc_id is taken as another document.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.common import map_texts
from lexmill.plans.stage import cut

BLOCK_TOKENS = 1024
SHARDS, BUCKETS = 16, 4096
MAX_TARGETS = 10_000
SEED = 17


def encoder(path: str | None = None):
    """encode_ordinary of the byte-level vocabulary at path (the installed public one by default)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def name_of(c):
    return F.lower(F.regexp_replace(c, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", ""))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source as lower-cased and trimmed, n_tokens)."""

    def make():
        encode = encoder(path)

        def f(ids, sources, texts):
            return {"doc_id": ids, "source": sources, "n_tokens": [len(encode(t)) for t in texts]}

        return f

    named = documents.where(F.col("source").isNotNull()).select("doc_id", name_of(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(named, "doc_id bigint, source string, n_tokens bigint", make, "doc_id", "source", "text")


def apportion(weights: dict, seats: int, caps: dict) -> dict:
    """Sainte-Lague: seats by the highest weight / (2 * seats + 1), nobody above the cap; ties by key. Fewer seats if all are full.

    All but a few seats per party are given at once: at least floor(quota) - n of them are certain.
    """
    got = dict.fromkeys(weights, 0)
    live = {k for k, w in weights.items() if w > 0 and caps[k] > 0}
    left = seats
    while live and left:
        total = sum(weights[k] for k in live)
        base = sum(got[k] for k in live)
        sure = {k: min(caps[k], int(weights[k] / total * (left + base)) - 1) - got[k] for k in live}
        step = {k: v for k, v in sure.items() if v > 0}
        if not step or sum(step.values()) > left:
            break
        for k, v in step.items():
            got[k] += v
            left -= v
        full = {k for k in live if got[k] >= caps[k]}
        live -= full
        if not full:
            break
    heap = [(-weights[k] / (2 * got[k] + 1), k) for k in live]
    heapq.heapify(heap)
    while left and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


class Mix:
    """Plan of a mix: the cut token counts, the totals and the quotas."""

    def __init__(self, documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, path: str | None = None):
        spark = documents.sparkSession
        rows = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.targets: dict[str, tuple[str, float, int]] = {}
        for r in rows:
            self.targets.setdefault(r.source.strip().lower(), (r.source, max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0)))
        self.block, self.seed = block_tokens, seed
        wanted = spark.createDataFrame([(k,) for k in self.targets], "source string")
        kept = documents.select("doc_id", "source", "text").where(F.col("source").isNotNull())
        kept = kept.withColumn("key", name_of(F.col("source"))).join(F.broadcast(wanted.withColumnRenamed("source", "key")), "key", "left_semi")
        place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
        counts = token_counts(kept, path).withColumn("shard", (place % SHARDS).cast("int")).withColumn("bucket", F.shiftright(place, 63 - (BUCKETS.bit_length() - 1)).cast("int"))
        self.counts = cut(counts)
        self.held: dict[str, dict[int, int]] = {k: {} for k in self.targets}
        for r in self.counts.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():  # SHARDS rows a target at most
            self.held[r.source][r.shard] = r.n
        self.tokens = {k: sum(v.values()) for k, v in self.held.items()}
        self.total = sum(self.tokens.values())
        shares = {k: t[1] for k, t in self.targets.items()}
        free = dict.fromkeys(self.targets, 1 << 62)
        self.capacity = {k: t[2] * self.tokens[k] for k, t in self.targets.items()}
        #: Tokens and blocks that each source would get if nothing limited it, and blocks that it gets.
        self.asked = apportion(shares, self.total, free)
        self.wished = apportion(shares, -(-self.total // block_tokens), free)
        self.blocks = apportion(shares, -(-self.total // block_tokens), {k: -(-c // block_tokens) for k, c in self.capacity.items()})
        #: (source, shard, tokens of the shard's quota, tokens of its documents).
        self.quota = []
        for k, n in self.blocks.items():
            held, repeats = self.held[k], self.targets[k][2]
            for shard, b in apportion({s: float(v) for s, v in held.items()}, n, {s: -(-v * repeats // block_tokens) for s, v in held.items()}).items():
                self.quota.append((k, shard, min(b * block_tokens, held[shard] * repeats), held[shard]))

    def documents(self) -> DataFrame:
        """(source as in targets, doc_id, n_tokens, copies): the documents of the mix."""
        spark = self.counts.sparkSession
        rows = [(k, self.targets[k][0], s, n // t if t else 0, n % t if t else 0, self.targets[k][2]) for k, s, n, t in self.quota]
        q = F.broadcast(spark.createDataFrame(rows, "source string, name string, shard int, whole bigint, rest bigint, most int"))
        key = ["source", "shard"]
        sums = self.counts.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("n")).join(q, key)
        end = F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # BUCKETS rows
        first = F.struct("bucket", "start")
        edge = sums.withColumn("start", end - F.col("n")).where(F.col("start") + F.col("n") >= F.col("rest")).groupBy(*key).agg(F.min(first).alias("edge"))
        plan = q.join(edge, key, "left").select(*key, "name", "whole", "rest", "most", F.col("edge.bucket").alias("edge"), F.coalesce("edge.start", F.lit(0)).alias("start"))
        d = self.counts.where("n_tokens > 0").join(F.broadcast(plan), key)  # SHARDS rows a target at most
        order = Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(self.seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("start") + F.sum("n_tokens").over(order)
        once = (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
        inside = d.where("bucket = edge").withColumn("more", (F.col("rest") > 0) & (upto - F.col("n_tokens") / 2 <= F.col("rest")))
        d = d.where("edge is null or bucket <> edge").withColumn("more", once).unionByName(inside)
        d = d.withColumn("copies", F.least(F.col("whole") + F.col("more").cast("bigint"), F.col("most").cast("bigint")))
        return d.where("copies > 0").select(F.col("name").alias("source"), "doc_id", "n_tokens", "copies")

    def shares(self) -> DataFrame:
        """One row for each target: asked, held, given and actual tokens, actual share, unreachable."""
        spark = self.counts.sparkSession
        plan = spark.createDataFrame(
            [(t[0], t[1], t[2], self.asked[k], self.tokens[k], self.blocks[k], self.wished[k], self.asked[k] > self.capacity[k]) for k, t in self.targets.items()],
            "source string, target_share double, max_repeats int, asked_tokens bigint, held_tokens bigint, quota_blocks bigint, wished_blocks bigint, unreachable boolean",
        )
        got = self.documents().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("n_documents"))
        got = plan.join(got, "source", "left").fillna(0, ["mix_tokens", "n_documents"])
        return got.withColumn("mix_share", F.round(F.col("mix_tokens") / F.greatest(F.sum("mix_tokens").over(Window.partitionBy()), F.lit(1)), 6))


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that win more blocks of one token than max_repeats times what they hold."""
    return Mix(documents, targets).shares().where("unreachable").select("source").distinct()
