"""Leaks, spans and near-duplicates against brute force."""

import random

import pytest

from lexmill.llm import leakage, neardup, spans
from lexmill.llm.common import words_of


def frame(spark, rows, key="doc_id", extra=True):
    d = spark.createDataFrame(rows, f"{key} bigint, text string")
    if extra:  # columns whose names the operators use inside
        for c in ("h1", "keys", "place", "digest", "a", "b", "bits", "weight"):
            d = d.withColumn(c, d[key])
    return d


def vocabulary(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def texts(seed, n, words, vocab=400):
    r, v = random.Random(seed), vocabulary(seed, vocab)
    return [" ".join(r.choice(v) for _ in range(r.randint(*words))) for _ in range(n)]


# ---- leaks -----------------------------------------------------------------------------------------------------------
def brute_leaks(docs, items, n=12):
    runs = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


def leak_case():
    r = random.Random(5)
    items = list(enumerate(texts(1, 40, (8, 50)))) + [(98, None), (99, "")]
    docs = []
    for d, t in enumerate(texts(2, 120, (0, 200))):
        w = t.split()
        for _ in range(r.randint(0, 2)):
            it = items[r.randrange(40)][1].split()
            a = r.randrange(len(it))
            part = it[a : a + r.randint(5, 40)]
            if r.random() < 0.4 and len(part) > 6:
                part[r.randrange(len(part))] = "Changed"
            w[len(w) // 2 : len(w) // 2] = [x.upper() + r.choice([",", "!", "\n", "_"]) for x in part]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, items[3][1] * 200), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [100, 100_000])
def test_leaks(spark, block):
    docs, items = leak_case()
    got = leakage.leaks(frame(spark, docs), frame(spark, items, "item_id"), block).where("longest_run >= 12").select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in got.collect()} == brute_leaks(docs, items)
    assert {tuple(r) for r in leakage.found(frame(spark, docs), frame(spark, items, "item_id")).collect()} == brute_leaks(docs, items)


def test_leaks_with_substitution(spark):
    item = " ".join(vocabulary(3, 40))
    w = item.split()
    for k in range(1, 36, 7):
        w[k] = "other"
    got = leakage.leaks(frame(spark, [(1, "before it " + " ".join(w)), (2, "nothing")]), frame(spark, [(7, item)], "item_id")).collect()
    assert [(r.doc_id, r.item_id, r.longest_run, r.overlap_words, r.matched_words) for r in got] == [(1, 7, 10, 40, 35)]
    assert leakage.found(frame(spark, [(1, " ".join(w))]), frame(spark, [(7, item)], "item_id")).count() == 0


def test_leaks_with_any_two_substitutions(spark):
    w = vocabulary(8, 12)
    docs, places = [], [(a, b) for a in range(12) for b in range(a + 1, 12)]
    for k, (a, b) in enumerate(places):
        d = w[:]
        d[a], d[b] = "one", "two"
        docs.append((k, "before " + " ".join(d) + " after"))
    three = w[:]
    three[0] = three[1] = three[6] = "other"
    docs.append((900, " ".join(three)))
    for block in (100_000, 0):
        got = leakage.leaks(frame(spark, docs), frame(spark, [(7, " ".join(w))], "item_id"), block).collect()
        assert {r.doc_id for r in got} == set(range(len(places))) and all((r.overlap_words, r.matched_words) == (12, 10) for r in got)


def test_leaks_alike_by_join(spark):
    docs, items = leak_case()
    a, b = (sorted(map(tuple, leakage.leaks(frame(spark, docs), frame(spark, items, "item_id"), block).distinct().collect())) for block in (100_000, 0))
    assert a == b and len(a) > 40


def test_no_leaks(spark):
    docs, items = frame(spark, [(1, "a b c")]), frame(spark, [(7, "a b c")], "item_id")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        assert leakage.found(d, i).count() == 0 and leakage.leaked_items(d, i).count() == 0


# ---- spans -----------------------------------------------------------------------------------------------------------
def brute_spans(docs, n=400):
    where = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(d)
    out = set()
    for d, t in docs:
        stretch = None
        for k in range(len(t or "") - n + 1):
            if len(where[t[k : k + n]]) > 1:
                if stretch and k <= stretch[1]:
                    stretch[1] = k + n
                else:
                    if stretch:
                        out.add((d, *stretch))
                    stretch = [k, k + n]
        if stretch:
            out.add((d, *stretch))
    return out


def span_case(seed):
    r = random.Random(seed)
    base = [list(t + " é😀") for t in texts(seed, 30, (100, 400))]
    docs = []
    for d in range(60):
        t = list(r.choice(base))[: r.randint(0, 300)]
        for _ in range(r.randint(0, 3)):
            s = r.choice(base)
            a = r.randrange(len(s))
            t += s[a : a + r.choice([150, 380, 399, 400, 401, 420, 700])]
        docs.append((d, "".join(t)))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_spans(spark, seed):
    docs = span_case(seed) + [(900, None), (901, "")]
    assert {tuple(r) for r in spans.spans(frame(spark, docs)).collect()} == brute_spans(docs)


def test_spans_periodic_and_copies(spark):
    wave = "ab" * 1000
    body = texts(9, 1, (150, 150))[0]
    docs = [(1, wave), (2, "x" * 7 + wave[:450] + "y"), (3, "-" * 401), (4, "-" * 900), (5, body), (6, body), (6, body), (7, "q" + body[:399]), (8, wave[:200])]
    assert {tuple(r) for r in spans.spans(frame(spark, docs)).collect()} == brute_spans(docs)
    got = {r.doc_id: r.shared_share for r in spans.shared_share(frame(spark, docs)).collect()}
    assert got[5] == 1.0 and got[3] == 1.0


def test_no_spans(spark):
    assert spans.spans(frame(spark, [(1, "a" * 500)])).count() == 0
    assert spans.spans(frame(spark, [(1, "a" * 500)]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spans.spans(frame(spark, [(1, "a")]), 50)


def test_windows_shuffled_once(spark):
    # The windows of 400 characters are most of what problem 8 shuffles.
    plan = spans.spans(frame(spark, span_case(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(h1#") == 1


# ---- near-duplicates -------------------------------------------------------------------------------------------------
def brute_pairs(docs):
    sets = {}
    for d, t in docs:
        w = words_of(t or "")
        if len(w) >= 30:
            sets[d] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))}


def dup_case():
    r = random.Random(11)
    docs, base = [], texts(4, 60, (40, 300), 3000)
    for t in base:
        docs.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            w = t.split()
            for _ in range(max(1, len(w) // r.choice([12, 20, 40]))):
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, "new"), lambda: w.insert(k, "added"), lambda: w.pop(k)])()
            if r.random() < 0.3:
                half = len(w) // 2
                w = w[half:] + w[:half]
            docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), None, "", "short text", " ".join(["same"] * 50), " ".join(["same"] * 50)]
    return list(enumerate(docs)) + [(0, docs[0])]


def test_near_duplicates(spark):
    docs = dup_case()
    records = frame(spark, docs, "row_id")
    want = brute_pairs(docs)
    got = {tuple(r) for r in neardup.found(records).collect()}
    assert got == want and len(want) > 50
    parts = {r.row_id: r.group_id for r in neardup.groups(records).collect()}
    assert all(parts[a] == parts[b] for a, b in got) and len(parts) == len({x for p in got for x in p})


def test_hot_key(spark):
    # A passage in a third of all records makes no pair; records that also share the rest do.
    passage = " ".join(vocabulary(21, 14))
    docs = [(k, t + (" " + passage if k % 3 == 0 else "")) for k, t in enumerate(texts(22, 150, (60, 90), 5000))]
    docs.append((999, docs[3][1] + " and one more"))
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id")).collect()} == brute_pairs(docs) == {(3, 999)}


def test_hot_group(spark):
    # Small edits of one text in many records: all links are found though every key is hot.
    r, body = random.Random(3), texts(23, 1, (120, 120), 2000)[0].split()
    docs = []
    for k in range(60):
        w = body[:]
        w[r.randrange(len(w))] = f"edit{k}"
        docs.append((k, " ".join(w)))
    docs += list(enumerate(texts(24, 60, (60, 90), 5000), 100))
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id")).collect()} == brute_pairs(docs)


#: Many parts, cells and buckets, tokens of more than 20 records split.
SMALL = neardup.Sizes(part=5_000, hot=20, probing=50, probed=70, pairs=500, partners=40)


def test_large_hot_group(spark, monkeypatch):
    # Several hundred variants with many spread edits: no token is both rare and common to a pair. Small parts and cells too.
    r, body = random.Random(31), texts(32, 1, (240, 240), 2000)[0].split()
    docs = []
    for k in range(300):
        w, phase = body[:], r.randrange(25)
        for j in range(phase, len(w), 25):
            w[j] = f"edit{k}x{j}"
        docs.append((k, " ".join(w)))
    docs += list(enumerate(texts(33, 30, (60, 90), 5000), 1000))
    want = brute_pairs(docs)
    assert len(want) > 40_000
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id")).collect()} == want
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id"), SMALL).collect()} == want
    monkeypatch.setattr(neardup, "SPREAD", 3)
    copies = [(2000 + k, docs[0][1]) for k in range(20)]
    assert {tuple(r) for r in neardup.found(frame(spark, docs[:40] + copies, "row_id"), SMALL).collect()} == brute_pairs(docs[:40] + copies)


@pytest.mark.parametrize("every", range(6, 13))
def test_found_at_any_rate(spark, every):
    # 40 pairs of 210 words with one edit every so many words: substitutions, insertions, deletions, and passages in another order.
    r, docs = random.Random(every), []
    for k, t in enumerate(texts(50 + every, 40, (210, 210), 1500)):
        w = t.split()
        for j in reversed(range(r.randrange(every), len(w), every)):
            kind = r.choice("ssid") if every > 6 else "s"
            w[j : j + 1] = {"s": [f"x{k}y{j}"], "i": [w[j], f"x{k}y{j}"], "d": []}[kind]
        if every > 8 and k % 4 == 0:
            w = w[100:] + w[:100]
        docs += [t, " ".join(w)]
    docs = list(enumerate(docs))
    want = brute_pairs(docs)
    assert len(want) >= (40 if every > 6 else 20)
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id"), SMALL).collect()} == want


def test_boilerplate_is_linear(spark):
    # Short records that share 30 of 62 words are no links, and twice as many of them make at most about twice as many candidates.
    passage, n = " ".join(vocabulary(61, 30)), []
    for size in (300, 600):
        docs = [(k, " ".join(vocabulary(1000 + k, 16)) + " " + passage + " " + " ".join(vocabulary(9000 + k, 16))) for k in range(size)]
        k = neardup.Links(frame(spark, docs, "row_id"))
        assert k.links.count() == 0
        n.append(neardup.candidates(*k.plan).count())
    assert n[1] <= 2.5 * n[0] + 50


def test_random_records_small_cells(spark):
    for seed in (1, 2):
        docs = list(enumerate(texts(70 + seed, 400, (30, 80), 25)))
        want = brute_pairs(docs)
        assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id"), SMALL).collect()} == want


def test_blocks_are_bounded(spark):
    # A passage in every record: blocks stay small, what is written grows with the records and not with the cells, a bounded number of matches is counted at once.
    passage, written, z = " ".join(vocabulary(81, 30)), [], neardup.Sizes(part=8_000, probed=100, hot=50, probing=7)
    for size in (150, 600):
        docs = [(k, " ".join(vocabulary(1000 + k // 2, 40)) + f" {passage} {k}") for k in range(size)]
        k = neardup.Links(frame(spark, docs, "row_id"), z)
        assert {(r.a, r.b) for r in k.links.collect()} == {(j, j + 1) for j in range(0, size, 2)}
        reps, sketch, at, _ = k.plan
        rows = neardup.blocks_of(neardup.postings(reps, sketch, at, z), at[2]).collect()
        assert at[2] >= size // 90 and {r.block for r in rows} == set(range(at[2]))
        for r in rows:
            ids, need = (neardup._unpack(b, d) for b, d in zip(neardup._split(bytes(r.records), 2), ("int64", "uint32")))
            assert len(ids) == len(need) <= 130
        written.append(sum(len(r.records) + len(r.probing) + len(r.met) for r in rows))
    assert written[1] <= 5 * written[0]


def test_evenly_edited(spark):
    # Common words, and a substitution every 6 to 16 words: no long run of words is shared. Among ten times as many other records.
    r, docs = random.Random(41), []
    for t in texts(42, 40, (90, 200), 400):
        w = t.split()
        for j in range(r.randrange(6), len(w), r.choice([6, 7, 10, 16])):
            w[j] = f"other{len(docs)}x{j}"
        docs += [t, " ".join(w)]
    docs = list(enumerate(docs + texts(43, 800, (60, 200), 400)))
    want = brute_pairs(docs)
    assert len(want) >= 30
    assert {tuple(r) for r in neardup.found(frame(spark, docs, "row_id")).collect()} == want


def test_no_near_duplicates(spark):
    d = frame(spark, [(1, "a b c"), (2, None), (None, "w " * 40)], "row_id")
    assert neardup.found(d).count() == neardup.groups(d).count() == neardup.found(d.limit(0)).count() == 0
