"""Apportionment against seat-by-seat counting, and mixes of small corpora."""

import random

from lexmill.llm import mixing


def seat_by_seat(weights, seats, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        live = [k for k in weights if weights[k] > 0 and got[k] < caps[k]]
        if not live:
            break
        k = min(live, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return got


def test_apportion():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 8)
        w = {k: r.choice([0.0, r.random(), r.random() * 10]) for k in range(n)}
        seats = r.choice([0, 1, r.randint(1, 500)])
        caps = {k: r.choice([0, r.randint(0, 100), 10**9]) for k in range(n)}
        assert mixing.apportion(w, seats, caps) == seat_by_seat(w, seats, caps)


def corpus(spark):
    r = random.Random(1)
    rows = []
    for k in range(600):
        source = r.choice([" Web ", "web", "WEB", "books", "tiny" if k % 9 == 0 else "web", None, "other"])
        rows.append((k, source, None if k % 97 == 0 else "word " * r.randint(0, 120), k))
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string, shard int")
    t = spark.createDataFrame([("web", 0.5, 1), ("Books", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    return d, t


def test_mix(spark):
    d, t = corpus(spark)
    m = mixing.Mix(d, t, block_tokens=64)
    docs = m.documents().collect()
    assert {r.source for r in docs} == {"web", "Books", "tiny"}
    assert all(1 <= r.copies <= {"web": 1, "Books": 2, "tiny": 3}[r.source] for r in docs)
    assert len({r.doc_id for r in docs}) == len(docs)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["absent"].unreachable and shares["absent"].mix_tokens == 0
    for r in shares.values():
        assert abs(r.mix_tokens - min(r.quota_blocks * 64, r.max_repeats * r.held_tokens)) <= 64 + 130
    assert {r.source for r in mixing.found(d, t).collect()} == {r.source for r in shares.values() if r.target_share / 1.1 * m.total > r.max_repeats * r.held_tokens}
    again = mixing.Mix(d.repartition(5), t, block_tokens=64).documents().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, docs))


def test_empty(spark):
    d, t = corpus(spark)
    assert mixing.Mix(d.limit(0), t).documents().count() == 0
    assert mixing.Mix(d, t.limit(0)).documents().count() == mixing.found(d, t.limit(0)).count() == 0
    assert mixing.found(d.limit(0), t).count() == 0


def test_found_by_the_contest(spark, monkeypatch):
    # Without the quotients nothing is unreachable; with them the one token too much decides.
    d = spark.createDataFrame([(k, "a" if k < 60 else "b", "word " * 10) for k in range(100)], "doc_id bigint, source string, text string")
    total = sum(r.n_tokens for r in mixing.token_counts(d).collect())
    rare = total * 40 // 100
    for asked, want in ((rare, set()), (rare + 1, {"b"})):
        t = spark.createDataFrame([("a", (total - asked) / total, 5), ("b", asked / total, 1)], "source string, target_share double, max_repeats int")
        assert {r.source for r in mixing.found(d, t).collect()} == want
    monkeypatch.setattr(mixing, "apportion", lambda weights, seats, caps: dict.fromkeys(weights, 0))
    assert mixing.found(d, t).count() == 0


def test_many_documents_in_buckets(spark):
    # The mix has each source's tokens within half a document a shard, whole documents only, and doesn't depend on partitions.
    r = random.Random(4)
    d = spark.createDataFrame([(k, r.choice("aaab"), "word " * r.randint(1, 30)) for k in range(3000)], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t, block_tokens=32)
    docs = m.documents().collect()
    for s in "ab":
        want = sum(q for k, _, q, _ in m.quota if k == s)
        assert abs(sum(x.n_tokens * x.copies for x in docs if x.source == s) - want) <= mixing.SHARDS * 16
    assert len({x.doc_id for x in docs}) == len(docs) and len({x.copies for x in docs if x.source == "b"}) == 2
    assert sorted(map(tuple, mixing.Mix(d.repartition(7), t, block_tokens=32).documents().collect())) == sorted(map(tuple, docs))
