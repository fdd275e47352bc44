"""Operators on small tables: rules in order, nulls, empty tables, ties, extra columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.operators import classify, decontaminate, dedup, lm, packing, runs, sampling, signals, status, training
from lexmill.plans.components import components
from lexmill.plans.prefix import running_total
from lexmill.plans import pipeline

WORDS = " ".join(f"w{k}" for k in range(60))
LONG = " ".join(f"word{k} something{k}" for k in range(60))


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_status_order(spark, docs):
    ten = " ".join(f"a{k}" for k in range(10))
    texts = ["few words", "ok " * 55, " ".join(["x" * 41, *(f"longer{k}" for k in range(60))]), " ".join([ten] * 6 + ["tail" * 5] * 30), LONG, None, ""]
    got = [r.s for r in docs(*texts).select("doc_id", status.quality_status(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got == ["too_few_words", "too_few_chars", "unnatural_word", "ngram_repetition", "kept", "too_few_words", "too_few_words"]
    texts = ["a ```", "<div><div><div>x", "{}" * 10 + "a" * 20, "def lambda self yield", "x" * 90 + "{}[]<>=\\_{", None]
    got = [r.s for r in docs(*texts).select("doc_id", status.code_status(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got == ["code_fence", "html_density", "symbol_ratio", "keyword_density", "kept", "kept"]


def test_ellipsis(spark, docs):
    got = [r.s for r in docs("a... b", "a b c d e f g h i j...", "plain", None).select("doc_id", status.ellipsis_status(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got == ["excessive_ellipsis", "kept", "kept", "kept"]


def test_verdicts_and_funnel(spark):
    d = spark.createDataFrame([(1, LONG, "en", 9), (2, LONG, "de", 9), (3, "", "en", 9), (4, "short", "EN", 9), (5, None, None, 9)], "doc_id bigint, text string, lang string, phase int")
    got = {r.doc_id: (r.phase, r.reason) for r in status.verdicts(d).collect()}
    assert got == {1: ("kept", "kept"), 2: ("language", "other_language"), 3: ("sanitize", "empty_after_clean"), 4: ("quality", "too_few_words"), 5: ("sanitize", "empty_after_clean")}
    assert [r.n_left for r in status.funnel(d).orderBy("step").collect()] == [5, 3, 2, 2, 1, 1]
    assert [r.n_left for r in status.funnel(d.limit(0)).orderBy("step").collect()] == [0] * 6
    skip = C.Config(skip=frozenset({"language"}))
    assert {r.doc_id for r in status.verdicts(d, skip).where("phase = 'kept'").collect()} == {1, 2}


def test_config():
    with pytest.raises(ValueError):
        C.Config(filter_mode="x")
    with pytest.raises(ValueError):
        C.Config(topic_distribution={"a": 0.0})
    assert C.Config.of({"seed": 1, "unknown": 2}).seed == 1


def test_decontaminate(spark, docs):
    items = docs("The Held-out  text", "", key="item_id")
    got = {r.doc_id: r.status for r in decontaminate.status(docs("the held-out text", "other", None, "Title: x"), items).collect()}
    assert got == {0: "test_overlap", 1: "kept", 2: "empty_after_normalize", 3: "empty_after_normalize"}
    got = {r.doc_id: (r.n_matched, r.contaminated) for r in decontaminate.char_overlap(docs("the held-out  text", "x", None), items).collect()}
    assert got == {0: (6, True), 1: (0, False), 2: (0, False)}


def test_exact_and_near(spark, docs):
    a = " ".join(f"tok{k}" for k in range(200))
    b = a + " one two three"
    c = " ".join(f"other{k}" for k in range(200))
    assert one(dedup.survivors(docs(a, a, c)), "doc_id") == [0, 2]
    assert sorted(one(dedup.survivors(docs(a, b, c)), "doc_id")) == [0, 2]
    short = docs("a b", "c", None, "", c)
    assert sorted(one(dedup.survivors(short), "doc_id")) == [0, 4]
    sig = dedup.signatures(short).collect()
    assert all(len(r.sig) == C.PERMUTATIONS for r in sig) and set(sig[1].sig) == {C.EMPTY_HASH}
    assert [r.similarity for r in dedup.estimated_similarity(docs(a, a)).collect()] == [1.0]
    assert [r.similarity for r in dedup.estimated_similarity(docs("a", "b")).collect()] == [0.0]
    assert [(r.n_docs, r.first_id) for r in dedup.exact_clusters(docs("A  b", "a b", "c")).collect()] == [(2, 0)]
    assert dedup.clusters(docs(a).limit(0)).count() == 0


def test_components(spark):
    e = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (5, 5), (300, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def test_running_total(spark):
    rows = [(7 * k % 101, k % 5) for k in range(101)]
    got = {r.k: r.upto for r in running_total(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v", "upto", 8).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_samples(spark):
    d = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(300)], "doc_id bigint, topic string")
    got = sampling.lowest(d, "topic", {"a": 17, "b": 1000, "none": 3}, 1).groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in got} == {"a": 17, "b": 100}
    again = sampling.lowest(d.repartition(7), "topic", {"a": 17}, 1).where("topic = 'a'")
    assert sorted(one(again, "doc_id")) == sorted(one(sampling.lowest(d, "topic", {"a": 17}, 1).where("topic = 'a'"), "doc_id"))
    c = C.Config(topic_distribution={"a": 0.5, "b": 0.5}, topic_classes=("a", "b"))
    got = {r.topic: r["count"] for r in sampling.topic_resample(d, c).groupBy("topic").count().collect()}
    assert got == {"a": 150, "b": 100}
    assert sampling.docs_for_budget(1_000_000) == math.ceil(1_000_000 / 1085 / 0.7)
    assert sampling.budget_sample(d, 10_000, 3).count() == 14


def test_packing(spark):
    lens = spark.createDataFrame([(1, 30), (2, 5), (3, 0), (4, 65)], "doc_id bigint, n_tokens bigint")
    assert {r.doc_id: r.start for r in packing.offsets(lens).collect()} == {1: 0, 2: 30, 3: 35, 4: 35}
    c = C.Config(context_length=9, val_ratio=0.2)
    got = {r.split: (r.n_tokens, r.n_kept, r.n_chunks) for r in packing.split(lens, c).collect()}
    assert got == {"val": (20, 20, 2), "train": (80, 80, 8)}
    got = {(r.split, r.chunk): (r.first_doc, r.last_doc, r.n_docs) for r in packing.chunks(lens, c).collect()}
    assert got[("val", 0)] == (1, 1, 1) and got[("train", 1)] == (2, 4, 2) and len(got) == 10
    assert [r.start for r in packing.eval_windows(spark, 10, 3, 9).orderBy("window").collect()] == [0, 3, 6]
    got = {r.min_tokens: (r.dropped, r.kept) for r in packing.cutoffs(lens, (5, 31)).collect()}
    assert got == {5: (1, 3), 31: (3, 1)}
    assert {r.bin: r.n_docs for r in packing.histogram(lens).collect()} == {"(0,32]": 2, "(64,128]": 1}


def test_tokenize(spark, docs):
    got = {r.doc_id: (list(r.input_ids), r.n_tokens) for r in packing.tokenize(docs("Hello world", None)).collect()}
    assert got == {0: ([15496, 995, 50256], 3), 1: ([50256], 1)}


def test_signals(spark, docs):
    d = docs("AB c.\n\nHEADING LINE\nhttps://x.y 12", None)
    r = signals.signals(d).orderBy("doc_id").collect()
    assert r[0].paragraphs == 1 and r[0].headings == 1 and r[0].url_per_word == pytest.approx(1 / 6, abs=1e-6) and r[1].ttr == 0
    assert signals.correlations(signals.signals(d)).count() == 36
    got = signals.describe(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "n double"), "n").first()
    assert got.median == 2 and got.std == pytest.approx(1.247219, abs=1e-6)
    got = signals.composition(docs("a1", "b.")).first()
    assert (got.digit, got.punct, got.space, got.other) == (20, 20, 20, 40)
    assert [tuple(r) for r in signals.top_words(docs("The cat cat dog dogs", None)).collect()] == [("cat", 2), ("dog", 1), ("dogs", 1)]
    assert {r.tag: r.n for r in signals.tag_counts(docs("<b>é", "Title: x", "Traceback (most recent call last)")).collect()} == {"html": 1, "non_ascii": 1, "header": 1, "stacktrace": 1}
    assert {r.tag: r.n for r in signals.boilerplate_counts(docs("Title: x\nURL: y\n*** start of a")).collect()} == {"title:": 1, "url:": 1, "*** start of": 1}


def test_correlations_of_the_matrix_or_of_asked_columns(spark, docs):
    sig = signals.signals(docs("AB c. D e.", "x y"))
    got = {(r.a, r.b) for r in signals.correlations(sig).collect()}
    assert len(got) == 36 and not any("sentence" in c for pair in got for c in pair)
    assert signals.correlations(sig, signals.SIGNALS).count() == 55
    r = signals.correlations(sig, ("sentences", "words_per_sentence")).collect()
    assert [(x.a, x.b, x.r) for x in r] == [("sentences", "words_per_sentence", None)]


def test_unigram(spark, docs):
    got = {r.doc_id: r.log_prob for r in lm.unigram_scores(docs("a a b", "", None)).collect()}
    assert got[0] == pytest.approx((2 * math.log(3 / 5) + math.log(2 / 5)) / 3, abs=1e-6) and got[1] == got[2] == -20


def lines(spark):
    rows = [("r", 1, "step", 0, 5.0, None), ("r", 2, "eval", None, None, 4.0), ("r", 3, "step", 25, 3.0, None), ("r", 4, "eval", None, None, 5.0), ("r", 5, "eval", None, None, 6.0), ("r", 5, "eval", None, None, 6.0)]
    d = spark.createDataFrame(rows, "run_name string, line_no bigint, record_type string, step bigint, train_loss double, val_loss double")
    for c in ("eval_train_loss", "grad_norm", "tokens_per_sec"):
        d = d.withColumn(c, F.lit(None).cast("double"))
    return d.withColumn("logged_at", F.lit(None).cast("timestamp"))


def test_runs(spark):
    m = lines(spark)
    assert [(r.step, r.ema) for r in runs.smoothed(m).orderBy("step").collect()] == [(0, 5.0), (25, pytest.approx(4.96))]
    assert [(r.step, r.val_loss, r.gap) for r in runs.eval_points(m).orderBy("line_no").collect()] == [(0, 4.0, None), (25, 5.0, None), (25, 6.0, None)]
    assert [r.stop_line for r in runs.early_stop(m, 2).collect()] == [5]
    assert [r.stop_line for r in runs.early_stop(m, 3).collect()] == [None]
    assert [(r.step, r.val_loss) for r in runs.best_n(m, 2).collect()] == [(0, 4.0), (25, 5.0)]
    assert runs.summary(m.limit(0)).count() == 0


def test_checkpoints(spark):
    rows = [("run_a", "last_step_000900.pt", None, "last", 1.0, True), ("run_b", "best_step_000100_val_4p0000.pt", None, "best", 5.0, True), ("run_b", "last_step_000100.pt", None, "last", 4.0, True), ("run_b", "last_step_000200.pt", None, "last", 6.0, False), ("run_c", "x.pt", None, "last", 9.0, False)]
    c = spark.createDataFrame(rows, "run_name string, ckpt_name string, step bigint, ckpt_kind string, mtime double, is_valid boolean")
    assert tuple(runs.latest(c).first()) == ("run_b", "last_step_000100.pt", 100)
    assert runs.latest(c, validate=False).first().run_name == "run_c"
    assert [r.step for r in runs.last_n(c.where("run_name = 'run_b'"), 1).collect()] == [200]


def test_ranking(spark):
    old = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "dataset string, val double")
    new = spark.createDataFrame([("a", 0.5), ("c", None)], "dataset string, val double")
    assert [tuple(r) for r in runs.upsert_ranking(old, new, "dataset", "val").orderBy("rank").collect()] == [("a", 0.5, 1), ("b", 1.0, 2), ("c", None, 3)]


def test_training(spark):
    lr = [r.lr for r in training.lr_schedule(spark, "wsd", 5, 20, 1.0, 0.1).orderBy("step").collect()]
    assert lr[:5] == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0]) and lr[17:] == pytest.approx([1.0, 0.55, 0.1])
    assert [r.lr for r in training.lr_schedule(spark, "cosine", 5, 20, 1.0, 0.1).orderBy("step").collect()][-1] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        training.lr_schedule(spark, "other", 5, 20, 1.0, 0.1)
    s = spark.createDataFrame([("g", "a", math.log(0.6)), ("g", "b", math.log(0.3)), ("g", "c", math.log(0.1)), ("g", "d", None)], "group string, item string, logit double")
    assert sorted(one(training.nucleus(s, 0.7), "item")) == ["a", "b"]
    assert sorted(one(training.nucleus(s, 1.0, 1), "item")) == ["a"]
    assert training.resume(5, 3, 4) == (2, 3)
    t = spark.createDataFrame([(1, 2, "assistant", "yo"), (1, 1, "user", "hi"), (2, 1, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    assert {r.conv_id: r.prompt for r in training.prompt(t).collect()} == {1: "User: hi\nAssistant: yo\nAssistant:", 2: "User: \nAssistant:"}
    d = spark.range(50).withColumnRenamed("id", "doc_id")
    assert training.shuffled(d, 1, 0, 10).count() == 40 and training.shuffled(d, 1, 0, 60).count() == 0
    assert one(spark.range(1).select(training.human_count(F.lit(35_800_000)).alias("x")), "x") == ["35.8M"]


def test_pipeline(spark):
    texts = [LONG, LONG + " more", WORDS + " " + LONG.replace("word", "term"), "short", None]
    d = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, clean string")
    held = spark.createDataFrame([(1, WORDS)], "item_id bigint, text string")
    got = pipeline.curate(d, held)
    assert sorted(one(got, "doc_id")) == [0, 2]
    assert sorted(one(pipeline.tokens(got, C.Config(min_tokens=10)), "doc_id")) == [0, 2]
    assert pipeline.curate(d.limit(0), held).count() == 0


def test_classifier(spark, docs):
    rows = [(f"def f{k}(self): return {k}", 1) for k in range(40)] + [(f"the cat number {k} sat on the mat", 0) for k in range(40)]
    model = classify.train(spark.createDataFrame(rows, "text string, label int"))
    got = {r.doc_id: (r.status, r.code_score) for r in classify.code_filter(docs("def f99(self): return 1\nthe cat", "the cat sat on the mat", None), model).collect()}
    assert [got[k][0] for k in range(3)] == ["classifier_code", "kept", "kept"] and got[2][1] == 0.0


def test_labelled_language(spark):
    rows = [(1, "EN", 0.9, 1), (1, "de", 0.9, 0), (2, "en", 95.0, 1), (3, "en", 0.7, 1), (4, None, 0.9, 1), (5, "en", None, 1)]
    d = spark.createDataFrame(rows, "row_id bigint, lang string, lang_conf double, at int").selectExpr("row_id", "lang", "lang_conf", "timestamp_seconds(at) detected_at")
    assert sorted(map(tuple, classify.labelled_language(d).collect())) == [(1, "en", 0.9), (2, "en", 0.95)]


def test_labelled_language_notations(spark):
    rows = [(k, x, 0.9) for k, x in enumerate(["en", "eng", "English", "en-GB", "EN_us", "__label__en", " en ", "de", "la", "unknown", "", "end"])]
    d = spark.createDataFrame(rows, "row_id bigint, lang string, lang_conf double").withColumn("detected_at", F.timestamp_seconds(F.lit(0)))
    assert sorted((r.row_id, r.lang) for r in classify.labelled_language(d).collect()) == [(k, "en") for k in range(7)]
    assert [r.row_id for r in classify.labelled_language(d, "de").collect()] == [7]


def test_verified_near_duplicates(spark, docs):
    # Single substitutions at growing numbers: similarities on both sides of 0.8, against brute force.
    r, texts = random.Random(7), []
    for g in range(30):
        words = [f"g{g}w{r.randrange(500)}" for _ in range(r.randint(60, 150))]
        texts.append(" ".join(words))
        for k in (1, 2, 3, 4, 6, 9):
            w = words[:]
            for j in r.sample(range(len(w)), k):
                w[j] = f"new{g}x{k}x{j}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "a b", "A  b", "c d", "", None, "same " * 60, "same " * 70]
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        if w:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    close = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(x.a, x.b) for x in dedup.similar(docs(*texts)).collect()}
    reps = {min(b for b in sets if sets[b] == sets[a]) for a in sets}
    assert got == {(a, b) for a, b in close if a in reps and (b in reps or sets[a] == sets[b])} and len(got) > 50
    root = {k: k for k in range(len(texts))}
    for a, b in close:
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    skip = C.Config(filter_mode="none", skip=frozenset({"sanitize", "language", "code", "quality", "ellipsis", "decontaminate"}))
    left = pipeline.curate(docs(*texts).withColumn("lang", F.lit("en")), docs("x", key="item_id"), skip)
    assert sorted(one(left, "doc_id")) == sorted({*root.values()})
    assert dedup.similar(docs("a").limit(0)).count() == 0


def test_classifier_mode_and_confidence(spark, docs):
    word = lambda w, k: " ".join(f"{w}{k}x{i}" for i in range(60))
    fence = "some words\n" + " ".join(f"``` step{i}" for i in range(60))
    texts = ["plain words here few plain words of a text some words", "shell make install now\n" + word("rest", 2), "gossip gossip gossip gossip", "few plain words of a short text in quite another manner than others", "again " * 50]
    d = docs(*texts, fence).withColumn("lang", F.lit("en"))
    code = classify.train(spark.createDataFrame([("shell make install now", 1), ("plain words here", 0), ("some words", 0), ("few plain words", 0)] * 5, "text string, label int"))
    education = classify.train(spark.createDataFrame([("gossip gossip gossip", 0), ("plain words", 1), ("few plain words of a text", 1)] * 5, "text string, label int"))
    run = lambda d, **k: sorted(one(pipeline.curate(d, docs("x", key="item_id"), C.Config(skip=frozenset({"sanitize"}), **k), models={"code": code, "education": education}), "doc_id"))
    model = run(d, filter_mode="classifier")
    assert 0 in model and 3 in model and 1 not in model and 2 not in model
    assert 3 not in run(d, filter_mode="heuristic")
    with pytest.raises(ValueError):
        pipeline.curate(d, docs("x", key="item_id"), C.Config(filter_mode="classifier"))
    with pytest.raises(ValueError):
        status.verdicts(d, C.Config(filter_mode="classifier"))
    sure = d.withColumn("lang_conf", F.element_at(F.array(*map(F.lit, (0.9, 95.0, 0.7, None, 0.0, 0.8))), (F.col("doc_id") + 1).cast("int")))
    assert {r.doc_id for r in status.verdicts(sure).where("reason = 'other_language'").collect()} == {2, 3, 4}
    assert run(sure, filter_mode="none") == [0, 1, 5] and run(sure, filter_mode="none", min_confidence=0.9) == [0, 1]
