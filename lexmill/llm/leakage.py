"""Problem 6: test items inside training documents, by spaced-seed hashing.

Each mask looks at MASK_SPAN consecutive words and ignores some of them; the hashes of the remaining words of all test
items form an index, and the same hashes of every document are looked up in it. Each hit fixes an alignment
(document, item, shift), which is then verified word by word: the longest exact run, and the stretch covered by
windows of MASK_SPAN words with at most MAX_SUBSTITUTIONS differing ones.

The places of a window fall into four groups (by their number modulo 4), and each of the six masks ignores two of them. Any
two places are in two groups at most, so any MAX_SUBSTITUTIONS = 2 substitutions are ignored by a mask and such windows are
always found; an exact run of MASK_SPAN words is found by every mask.

Items of up to BLOCK_WORDS words in all are one index, sent to the executors, and the documents are read once. More are
indexed as a table: documents send only the hashes that a bitmap of all items lets through, these are joined by shuffle, and
the documents are read a second time to verify their hits. The result is the same.

Nulls, empty texts and items shorter than MASK_SPAN words give no row. Repeated documents give equal rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Hashes, flat_hashes, map_texts, mix, words_of
from lexmill.plans.stage import cut

MASK_SPAN = 12
#: Positions that each mask ignores.
MASKS = tuple(tuple(j for j in range(MASK_SPAN) if j % 4 in (a, b)) for a in range(4) for b in range(a + 1, 4))
MAX_SUBSTITUTIONS = 2
BLOCK_WORDS = 400_000
#: Bits of the bitmap over the hashes of all items, as a power of 2, where they are too many to send.
BITMAP = 27

SCHEMA = "doc_id bigint, item_id bigint, longest_run int, overlap_words int, matched_words int, item_words int, doc_word bigint"
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * j + 3) ^ (0xD6E8FEB86659FD93 >> j)) | 1 for j in range(MASK_SPAN)], dtype=object)
_MULT = np.array([int(x) & (2**64 - 1) for x in _MULT], np.uint64)


def masked(flat: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each window of MASK_SPAN words without the positions in mask."""
    m = len(flat) - MASK_SPAN + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(MASK_SPAN):
        if j not in mask:
            h += flat[j : j + m] * _MULT[j]
    return mix(h)


class Index:
    """Sorted mask hashes of test items, with a bitmap that turns most look-ups down."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        memo = Hashes()
        self.ids = [i for i, _ in items]
        self.words, starts = flat_hashes([w for _, w in items], memo)
        self.starts = starts
        owner = np.repeat(np.arange(len(items)), np.diff(starts))
        self.tables = []
        for mask in MASKS:
            h = masked(self.words, mask)
            ok = owner[: len(h)] == owner[MASK_SPAN - 1 :] if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(ok)
            order = np.argsort(h[at], kind="stable")
            h, at = h[at][order], at[order]
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((h, at, owner[at], bits))

    def hits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Unique (document, item, shift) rows of all hits, as numbers within the batch and the index."""
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        found = []
        for mask, (h, at, item, bits) in zip(MASKS, self.tables):
            x = masked(flat, mask)
            if not len(x) or not len(h):
                continue
            pos = np.flatnonzero(bits[(x >> np.uint64(44)).astype(np.int64)])
            pos = pos[owner[pos] == owner[pos + MASK_SPAN - 1]]
            lo, hi = np.searchsorted(h, x[pos], "left"), np.searchsorted(h, x[pos], "right")
            n = hi - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            each = np.repeat(np.arange(len(pos)), n)
            k = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            p = pos[each]
            found.append(np.stack([owner[p], item[k], (p - starts[owner[p]]) - (at[k] - self.starts[item[k]])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def verify(doc: np.ndarray, it: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """Longest exact run, words overlapping with few substitutions, how many of them match, first such document word; the item `it` begins at the document's word `shift`."""
    a, b = max(0, shift), min(len(doc), len(it) + shift)
    eq = doc[a:b] == it[a - shift : b - shift]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], eq.astype(np.int8), [0]])))
    longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    total = np.concatenate([[0], np.cumsum(eq)])
    good = np.flatnonzero(total[MASK_SPAN:] - total[:-MASK_SPAN] >= MASK_SPAN - MAX_SUBSTITUTIONS)
    cover = np.zeros(len(eq) + 1, np.int64)
    np.add.at(cover, good, 1)
    np.add.at(cover, good + MASK_SPAN, -1)
    cover = np.cumsum(cover)[:-1] > 0
    return longest, int(cover.sum()), int((eq & cover).sum()), int(a + np.argmax(cover)) if len(good) else a


def leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that share a window of MASK_SPAN words with at most MAX_SUBSTITUTIONS differences.

    documents: doc_id, text; items: item_id, text. Columns: SCHEMA. A document's best alignment with an item counts.
    """
    some = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    # A word and the blank after it take two characters at least.
    if (some.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first().n or 0) > 4 * block_words:
        return leaks_by_join(documents, some)
    block = [(r.item_id, w) for r in some.collect() if len(w := words_of(r.text)) >= MASK_SPAN]
    index = documents.sparkSession.sparkContext.broadcast(Index(block))

    def make():
        ix, memo = index.value, Hashes()

        def f(ids, texts):
            flat, starts = flat_hashes([words_of(t) for t in texts], memo)
            best: dict[tuple[int, int], tuple] = {}
            for d, i, shift in ix.hits(flat, starts).tolist():
                v = verify(flat[starts[d] : starts[d + 1]], ix.words[ix.starts[i] : ix.starts[i + 1]], shift)
                if v[1] and v > best.get((d, i), (0,)):
                    best[d, i] = v
            rows = [(ids[d], ix.ids[i], *v[:3], int(ix.starts[i + 1] - ix.starts[i]), v[3]) for (d, i), v in best.items()]
            return {c.split()[0]: [r[k] for r in rows] for k, c in enumerate(SCHEMA.split(", "))}

        return f

    return map_texts(documents, SCHEMA, make, "doc_id", "text")


def seeds(texts: DataFrame, key: str, bitmap=None) -> DataFrame:
    """(key, mask, hash, at) of every window under every mask; only those that the bitmap lets through if there is one."""

    def make():
        memo = Hashes()

        def f(ids, texts):
            flat, starts = flat_hashes([words_of(t) for t in texts], memo)
            owner, ids = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.array(ids, np.int64)
            cols: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for k, mask in enumerate(MASKS):
                h = masked(flat, mask)
                at = np.flatnonzero(owner[: len(h)] == owner[len(flat) - len(h) :]) if len(h) else np.zeros(0, np.int64)
                if bitmap is not None:
                    b = (h[at] >> np.uint64(64 - BITMAP)).astype(np.int64)
                    at = at[(bitmap.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0]
                for c, v in zip(cols, (ids[owner[at]], np.full(len(at), k), h[at].view(np.int64), at - starts[owner[at]])):
                    c.append(v)
            return dict(zip((key, "mask", "hash", "at"), map(np.concatenate, cols)))

        return f

    return map_texts(texts, f"{key} bigint, mask int, hash bigint, at int", make, key, "text")


def leaks_by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() with the items as a table, for any number of them."""
    index = cut(seeds(items, "item_id"))
    bit = F.shiftrightunsigned("hash", 64 - BITMAP)
    octets = index.groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(F.pow(F.lit(2), bit % 8).cast("int")).alias("bits")).toArrow()  # 2 ** (BITMAP - 3) rows at most
    bitmap = np.zeros(1 << (BITMAP - 3), np.uint8)
    bitmap[octets.column(0).to_numpy()] = octets.column(1).to_numpy()
    near = cut(seeds(documents, "doc_id", documents.sparkSession.sparkContext.broadcast(bitmap)))
    # Two plain tables, so that adaptive execution can split a hot hash.
    hits = near.join(index.withColumnRenamed("at", "item_at"), ["mask", "hash"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = cut(hits.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")))
    both = pairs.join(items.select("item_id", F.col("text").alias("item")), "item_id").join(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")

    def make():
        memo = Hashes()

        def f(ids, item_ids, shifts, its, texts):
            rows = []
            for d, i, at, it, t in zip(ids, item_ids, shifts, its, texts):
                doc, item = (flat_hashes([words_of(x)], memo)[0] for x in (t, it))
                v = max(verify(doc, item, s) for s in at)
                if v[1]:
                    rows.append((d, i, *v[:3], len(item), v[3]))
            return {c.split()[0]: [r[k] for r in rows] for k, c in enumerate(SCHEMA.split(", "))}

        return f

    return map_texts(both, SCHEMA, make, "doc_id", "item_id", "shifts", "item", "text")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() with the share of the item that overlaps."""
    return leaks(documents, items).withColumn("coverage", F.round(F.col("overlap_words") / F.col("item_words"), 6))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item that leaked: in how many documents, in how many whole, and the longest exact run."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_distinct(F.when(F.col("longest_run") == F.col("item_words"), F.col("doc_id"))).alias("n_whole"),
        F.max("longest_run").alias("longest_run"),
    )


def found(documents: DataFrame, items: DataFrame, least: int = MASK_SPAN) -> DataFrame:
    """(doc_id, item_id) where at least `least` consecutive words of the item stand in the document."""
    return leaks(documents, items).where(F.col("longest_run") >= least).select("doc_id", "item_id").distinct()
