"""Problem 8: long exact spans shared between records, by content-defined chunking with a gear rolling hash.

1. A 32-character gear hash runs over each text; a chunk ends where it is the least of its 2 * HALF + 1 neighbours, so
   that a boundary depends on 32 + 2 * HALF characters only and insertions elsewhere don't move it. Gaps longer than
   LONG_GAP are cut again with the finer HALF_FINE; gaps still longer than DENSE_GAP give every DENSE_RUN-character
   window as a chunk. By this every run of LEAST characters that two texts share holds a chunk that both have, whatever
   the text (see the README for the counting).
2. Chunks are counted by digest (partial counts before the shuffle): a digest in two documents is shared.
3. Only around shared chunks, windows of LEAST - 2 * STEP + 1 characters at about every STEP-th place (counted from the
   least hash in the window, so that both texts choose the same places) are counted by digest in the same way.
4. Only around those that two documents have, every window of LEAST characters is counted by a 128-bit digest. A
   character is shared if such a window covers it; the windows of a document are merged to maximal stretches.

No pairs are formed, so a span in a third of all documents costs no more than any other: groups are reduced to the
least and the greatest document before and after the shuffle (in step 4 after it).

Null texts and texts under LEAST characters share nothing. Equal doc_id are one document: runs repeated only within
it do not count. Positions count code points.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.common import map_texts, mix
from lexmill.plans.stage import cut, semi_join

LEAST = 400
REACH = 32
HALF, LONG_GAP = 40, 140
HALF_FINE, DENSE_GAP, DENSE_RUN = 10, 71, 40
STEP = 8

_ONE = np.uint64(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The texts' code points in one array, their bytes, and where each text starts."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))])
    return np.frombuffer(raw, np.uint32), raw, starts


def gear(chars: np.ndarray) -> np.ndarray:
    """32-bit gear hash after each character: the sum of the last 32 characters' values, each shifted by its distance. By doubling."""
    h = (mix((chars.astype(np.uint64) + _ONE) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(13)).astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
    return h ^ (h >> np.uint32(15)) * np.uint32(0x85EBCA6B)


def least_around(h: np.ndarray, half: int) -> np.ndarray:
    """Where h is the least of the 2 * half + 1 values around it; False within half of either end."""
    n, w = len(h), 2 * half + 1
    out = np.zeros(n, bool)
    if n < w:
        return out
    m, k = h, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[: n - w + 1], m[w - k : w - k + n - w + 1])
    out[half : n - half] = h[half : n - half] == m
    return out


def chunks(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks, and the coarse boundaries; places within the whole array. A text's ends are boundaries too."""
    ends = np.zeros(len(h) + 1, bool)
    coarse = np.flatnonzero(least_around(h, HALF))
    ends[coarse] = True
    ends[starts] = True
    at = np.flatnonzero(ends)
    long = np.flatnonzero(np.diff(at) > LONG_GAP)
    if len(long):
        inside = np.zeros(len(h) + 1, np.int8)
        np.add.at(inside, at[long], 1)
        np.add.at(inside, at[long + 1], -1)
        inside = np.cumsum(inside)[:-1] > 0
        fine = np.flatnonzero(least_around(h, HALF_FINE) & inside)
        ends[fine] = True
        at2 = np.flatnonzero(ends)
    else:
        at2 = at
    a, b = at2[:-1], at2[1:]
    dense = b - a > DENSE_GAP
    if dense.any():
        dense &= inside[a] if len(long) else False
    if dense.any():
        n = (b - a - DENSE_RUN + 1)[dense]
        first = np.repeat(a[dense], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.concatenate([a, first]), np.concatenate([b, first + DENSE_RUN])
    text = np.searchsorted(starts, a, "right") - 1
    return text, a, b, at


def least_place(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first one) in each window of width values."""
    m, k = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), 1
    n = len(h) - width + 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[:n], m[width - k : width - k + n])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def digests(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    view, f = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((f(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a)).view(np.int64)


def chunk_rows(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, digest, place) of every chunk; place holds start and end."""

    def make():
        def f(ids, texts):
            chars, raw, starts = code_points(texts)
            text, a, b, _ = chunks(gear(chars), starts)
            order = np.argsort(a, kind="stable")
            text, a, b = text[order], a[order], b[order]
            lo, hi = starts[text], starts[text + 1]
            keep = hi - lo >= least
            text, a, b, lo = text[keep], a[keep], b[keep], lo[keep]
            ids = np.array(ids, np.int64)
            return {"doc_id": ids[text], "digest": digests(raw, a, b), "place": ((a - lo) << 32) | (b - lo)}

        return f

    return map_texts(documents, "doc_id bigint, digest bigint, place bigint", make, "doc_id", "text")


def shared_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in two documents; least and greatest are taken before the shuffle too."""
    g = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return g.where("lo <> hi").select(*keys)


def merge(a: np.ndarray, b: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, joined where they are at most gap apart."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1] + gap])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
    return a[new], b[last]


def window_rows(documents: DataFrame, places: DataFrame, least: int, schema: str, make_rows) -> DataFrame:
    """make_rows(chars, raw, starts, k, places of text k) -> {column: values} over the documents in places."""
    joined = semi_join(documents.select("doc_id", "text"), places, ["doc_id"], weight="size(places)")

    def make():
        def f(ids, where, texts):
            chars, raw, starts = code_points(texts)
            return make_rows(np.array(ids, np.int64), where, chars, raw, starts)

        return f

    return map_texts(joined, schema, make, "doc_id", "places", "text")


def spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal stretches of characters in runs of `least` that another document has too."""
    if least < LEAST:
        raise ValueError(f"chunk sizes are set for spans of {LEAST} characters or more")
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") >= least))
    rows = chunk_rows(docs, least)
    hot = rows.join(shared_keys(rows, "digest"), "digest", "left_semi")
    places = cut(hot.groupBy("doc_id").agg(F.collect_set("place").alias("places")))

    short = least - 2 * STEP + 1

    def coarse(ids, where, chars, raw, starts):
        h = gear(chars)
        bounds = chunks(h, starts)[3]
        out: list[tuple] = []
        for k, p in enumerate(where):
            lo, hi = int(starts[k]), int(starts[k + 1])
            p = np.array(p, np.int64)
            u, v = merge((p >> 32) + lo, (p & 0xFFFFFFFF) + lo)
            own = np.append(bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)], hi)
            # A shared run can't reach a coarse boundary outside the stretch and that boundary's surroundings: the chunk between would be shared.
            left = own[np.maximum(np.searchsorted(own, u, "left") - 1, 0)] - (REACH + HALF)
            right = own[np.minimum(np.searchsorted(own, v, "right"), len(own) - 1)] + HALF
            s, e = np.maximum(left, lo), np.minimum(right, hi) - short + 1
            if not (e > s).any():
                continue
            s, e = merge(s[e > s], e[e > s])
            # The place of the least hash in a window is the same wherever the window stands; taken are windows at a multiple of STEP from it and those where it changes.
            low = least_place(h[lo + REACH - 1 : hi], short - REACH + 1) + REACH - 1
            at = np.arange(len(low))
            take = ((low - at) % STEP == 0) | np.concatenate([[True], low[1:] != low[:-1]])
            ok = np.zeros(len(low) + 1, np.int64)
            np.add.at(ok, s - lo, 1)
            np.add.at(ok, e - lo, -1)
            at = at[take & (np.cumsum(ok)[:-1] > 0)]
            out.append((k, at + lo))
        if not out:
            return {"doc_id": [], "digest": [], "place": []}
        text = np.concatenate([np.full(len(at), k) for k, at in out])
        at = np.concatenate([at for _, at in out])
        return {"doc_id": ids[text], "digest": digests(raw, at, at + short), "place": at - starts[text]}

    near = window_rows(docs, places, least, "doc_id bigint, digest bigint, place bigint", coarse)
    hot = near.join(shared_keys(near, "digest"), "digest", "left_semi")
    places = cut(hot.groupBy("doc_id").agg(F.collect_set("place").alias("places")))

    def exact(ids, where, chars, raw, starts):
        view, g = memoryview(raw), xxhash.xxh3_128_intdigest
        cols: dict[str, list] = {"doc_id": [], "h1": [], "h2": [], "place": []}
        for k, p in enumerate(where):
            lo, n = int(starts[k]), int(starts[k + 1] - starts[k])
            p = np.unique(np.array(p, np.int64))
            s, e = merge(np.maximum(p - 2 * STEP + 1, 0), np.minimum(p, n - least) + 1)
            for s0, e0 in zip(s.tolist(), e.tolist()):
                for at in range(s0, e0):
                    d = g(view[4 * (lo + at) : 4 * (lo + at + least)])
                    cols["h1"].append((d >> 64) - 2**63)
                    cols["h2"].append((d & (2**64 - 1)) - 2**63)
                    cols["place"].append(at)
                cols["doc_id"] += [int(ids[k])] * max(0, e0 - s0)
        return cols

    last = window_rows(docs, places, least, "doc_id bigint, h1 bigint, h2 bigint, place int", exact)
    # These rows are the most, so they are shuffled once, with their documents, instead of twice; a digest's rows are sorted with spilling.
    alike = Window.partitionBy("h1", "h2")
    hot = last.withColumn("lo", F.min("doc_id").over(alike)).withColumn("hi", F.max("doc_id").over(alike)).where("lo <> hi")
    per = hot.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("p"))
    # A stretch begins at a place more than `least` after the one before, and ends `least` after its last place.
    first = F.filter(F.col("p"), lambda x, i: (i == 0) | (x - F.element_at("p", F.greatest(i, F.lit(1))) > least))
    last_ = F.filter(F.col("p"), lambda x, i: (i == F.size("p") - 1) | (F.element_at("p", F.least(i + 2, F.size("p"))) - x > least))
    both = F.arrays_zip(first.alias("a"), last_.alias("b"))
    out = per.select("doc_id", F.explode(both).alias("s"))
    return out.select("doc_id", F.col("s.a").cast("bigint").alias("span_start"), (F.col("s.b") + least).cast("bigint").alias("span_end"))


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """For each document with shared spans: their number, total length and share of the text."""
    s = spans(documents, least).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = documents.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    return s.join(size, "doc_id").withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
