"""Hot keys, long runs, trials, and the small functions around training and checkpoints."""

import datetime
import html
import math
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.python import nfc, unescape
from lexmill.operators import classify, decontaminate, dedup, lm, packing, runs, sampling, signals, status, training, trials
from lexmill.plans import components, pipeline, stage
from lexmill.plans.prefix import running_total
from lexmill.sources import files


def one(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_split_join(spark):
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(600)], "key int, v int").withColumn("lp", F.lit(1))
    keys = stage.cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    want = sorted(one(rows.join(keys.drop("n"), "key"), "key", "v", "least"))
    for limit, heavy in ((10, 50), (2, 300), (1, 300), (1, 10), (0, 10**9)):
        got = stage.split_join(rows, keys, ["key"], limit=limit, heavy=heavy)
        assert sorted(one(got, "key", "v", "least")) == want and "n" not in got.columns


def test_hub(spark, monkeypatch):
    monkeypatch.setattr(stage.split_join, "__defaults__", ("n", 3, 20))
    edges = [(0, k) for k in range(1, 200)] + [(500 + k, 501 + k) for k in range(6)] + [(150, 900), (7, 7), (None, 3)]
    got = dict(one(components.components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "component"))
    assert {k for k, c in got.items() if c == 0} == {*range(200), 900} and {k for k, c in got.items() if c == 500} == set(range(500, 507))
    words = [" ".join(random.Random(k % 40).choices("abcdefgh", k=9)) for k in range(120)] + ["same two"] * 60 + [None, ""]
    d = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    stars = set(one(dedup.links(d), "a", "b"))
    assert {(k, k + 40) for k in range(40)} <= stars and {(120, k) for k in range(121, 182)} <= stars


def test_running_total(spark):
    r = random.Random(3)
    rows = [(k, r.choice([0, 1, 5])) for k in r.sample(range(10_000), 500)]
    got = dict(one(running_total(spark.createDataFrame(rows, "k bigint, v bigint").repartition(3), "k", "v", "upto", 60), "k", "upto"))
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v
    assert running_total(spark.createDataFrame([], "k bigint, v bigint"), "k", "v", "upto").count() == 0


def metrics(spark, rows):
    cols = "run_name string, line_no bigint, record_type string, step bigint, train_loss double, grad_norm double, lr double, val_loss double, eval_train_loss double, tokens_per_sec double, val_ppl double, logged_at timestamp"
    names = [c.split()[0] for c in cols.split(", ")]
    at = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([tuple({"logged_at": at, **r}.get(n) for n in names) for r in rows], cols)


def test_smoothed_by_blocks(spark, monkeypatch):
    r, rows, want = random.Random(5), [], {}
    for run, n in (("long", 700), ("short", 3), ("gaps", 40)):
        mean = None
        for k in range(n):
            x = None if run == "gaps" and k % 3 == 0 else math.nan if k == 11 else r.random() * 9
            rows.append({"run_name": run, "line_no": k * (50 if run == "gaps" else 1), "record_type": "step", "step": k, "train_loss": x})
            if x is not None and x == x:
                mean = x if mean is None else mean * 0.98 + x * 0.02
                want[run, k] = mean
    monkeypatch.setattr(runs, "BLOCK_LINES", 64)
    got = {(a, b): e for a, b, e in one(runs.smoothed(metrics(spark, rows + rows[:5])), "run_name", "step", "ema")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert runs.smoothed(metrics(spark, rows).limit(0)).count() == 0


def test_alerts(spark):
    step = lambda k, **v: {"run_name": "r", "line_no": k, "record_type": "step", "step": k * 100, **v}
    ev = lambda k, v, t: {"run_name": "e", "line_no": k, "record_type": "eval", "val_loss": v, "eval_train_loss": t}
    rows = [step(1, grad_norm=11.0, train_loss=9.0, lr=0.0), step(2, grad_norm=1.0, train_loss=8.0, lr=0.0), step(3, train_loss=7.5), step(4, train_loss=2.0, grad_norm=math.nan, lr=0.1)]
    rows += [ev(k, 3.0, 2.9 - 0.2 * k) for k in range(5)] + [ev(5, math.nan, 1.0)]
    assert set(one(runs.alerts(metrics(spark, rows)), "run_name", "line_no", "alert")) == {
        ("r", 1, "gradient"), ("r", 2, "gradient"), ("r", 2, "loss"), ("r", 3, "loss"), ("r", 1, "rate"), ("r", 2, "rate"),
        ("e", 3, "overfitting"), ("e", 4, "overfitting"), ("e", 4, "stagnation"),
    }


def test_curve_retention_listing(spark):
    p = spark.createDataFrame([(0, 5.0), (10, 3.0), (20, 1.0), (20, None), (None, 2.0), (5, math.nan)], "step bigint, loss double")
    assert set(one(runs.curve(p, 5, 3), "x", "y")) == {(0, 2), (2, 1), (4, 0)}
    assert set(one(runs.curve(p.withColumn("loss", F.lit(2.0)), 5, 3), "y")) == {0} and runs.curve(p.limit(0)).count() == 0
    e = spark.createDataFrame([("r", k, k, v) for k, v in enumerate([5.0, 4.0, 4.5, 4.5, math.nan, None, 3.0])], "run_name string, line_no bigint, step bigint, val_loss double")
    assert [k for _, k in sorted(one(runs.retained_best(e), "line_no", "kept"))] == [True, True, True, False, False, False, True]
    c = spark.createDataFrame([("r", "a.pt", None, "last", 5.0, True), ("r", "12_epoch_3_step", None, "last", 9.0, True), ("r", "notes.txt", None, "last", 10.0, True)], "run_name string, ckpt_name string, step bigint, ckpt_kind string, mtime double, is_valid boolean")
    assert one(runs.listed(c), "ckpt_name") == ["12_epoch_3_step", "a.pt"]
    n = spark.range(1).select(runs.checkpoint_name(F.lit("last"), F.lit(3), F.lit(120)).alias("c"), runs.run_folder(F.lit("2026-03-06 14:36:41").cast("timestamp"), "x").alias("f"))
    assert one(n, "c", "f") == [("last_epoch_0003_step_0000120.pt", "run_20260306_143641_x")]


def test_trials(spark):
    preset = "d_model=64,n_layers=2,n_heads=4,d_ff=160"
    rows = [(1, "COMPLETE", 5.0, preset, 0.01, None), (2, "COMPLETE", math.nan, None, 0.02, 100), (3, "FAIL", None, None, None, 96), (4, "COMPLETE", 4.0, None, 0.5, None), (5, "PRUNED", 1.0, None, 0.5, None), (6, "COMPLETE", 5.0, None, 0.5, 10)]
    t = spark.createDataFrame(rows, "number int, state string, value double, architecture_preset string, learning_rate double, d_model bigint")
    assert one(trials.best(t, 3), "rank", "number") == [(1, 4), (2, 1), (3, 6)] and one(trials.best(t), "number")[-1] == 2
    assert {r.state: (r.n, r.best) for r in trials.by_state(t).collect()} == {"COMPLETE": (4, 4.0), "FAIL": (1, None), "PRUNED": (1, 1.0)}
    got = {r.number: r for r in trials.resolved(t).collect()}
    assert (got[1].d_model, got[1].d_ff, got[1].n_heads) == (64, 160, 4) and got[1].min_lr == pytest.approx(0.001)
    assert (got[2].d_ff, got[3].d_ff, got[3].min_lr, got[4].d_ff) == (266, 256, None, None)
    assert trials.best(t.limit(0)).count() == trials.by_state(t.limit(0)).count() == 0
    s = spark.range(1).select(trials.preset(*map(F.lit, (64, 2, 4, 160))).alias("p"), trials.tokens_per_second(*map(F.lit, (10, 4, 2, 256)), F.lit(5.0)).alias("t"))
    assert one(s, "p", "t") == [(preset, 4096.0)]


def test_prompt_ends(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5], " yes \nUser: and"), ([1], "no"), ([], None)], "ids array<int>, g string")
    assert one(d.select(training.last_tokens(F.col("ids"), 5, 2).alias("i")), "i") == [[3, 4, 5], [1], []]
    assert one(d.select(training.reply(F.col("g")).alias("g")), "g") == ["yes", "no", None]
    a = spark.createDataFrame([("Line one\nmore", "4 out of 5"), ("x", "score 3"), ("", "2"), ("y", None), ("z", "0"), (None, "1")], "text string, answer string")
    assert one(classify.annotated_lines(a), "line") == ["__label__4 Line one"]


def test_all_entities(spark, docs):
    texts = [f"q &{k} r" for k in html5] + [f"&#{n};" for n in (0, 13, 39, 128, 8220, 55296, 64976, 128512, 1114112)] + ["&#x27;y&#X41 &amp;lt; &notit; &foo; a & b", "no <i>tag</i> &lt;b&gt;", "", None]
    got = one(docs(*texts).select("doc_id", unescape(F.col("text")).alias("t"), T.strip_html(T.text(F.col("text"))).alias("h")).orderBy("doc_id"), "t", "h")
    assert [g for g, _ in got[:-1]] == [html.unescape(t) for t in texts[:-1]] and got[-1] == (None, "")
    assert got[-3][1] == "no  tag  <b>"
    assert one(docs("é", "é", None, "Å").select("doc_id", nfc(F.col("text")).alias("n")).orderBy("doc_id"), "n") == ["é", "é", "", "Å"]


def test_strip_is_all_blanks(docs):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert one(docs(*(f"{b}a{b}b{b}" for b in blanks)).select(T.strip(F.col("text")).alias("t")), "t") == [f"a{b}b" for b in blanks]


def test_signals_and_samples(spark, docs):
    d = docs("One. Two. Three words here.", "", None)
    assert one(signals.signals(d).orderBy("doc_id"), "sentences", "words_per_sentence") == [(2, 2.5), (1, 1.0), (1, 1.0)]
    n = spark.range(101).select(F.col("id").alias("n_tokens"))
    assert dict(one(signals.percentiles(n), "percentile", "value")) == {p: p for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    assert one(signals.percentiles(n.limit(0)), "value") == [None] * 9
    langs = spark.createDataFrame([(1, "EN", "x"), (2, None, "y" * 200), (3, "de", None)], "doc_id bigint, lang string, text string")
    assert {r.doc_id: (r.lang, len(r.preview)) for r in signals.other_languages(langs).collect()} == {2: ("unknown", 100), 3: ("de", 0)}
    s = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("g"))
    few = sampling.few(s, "g", 7, 1)
    assert few.groupBy("g").count().where("count = 7").count() == 3 and few.columns == ["doc_id", "g"]


def test_ngram_model(spark, docs):
    d = docs("a b c a b d", "a b", "c", None, "  ")
    got = dict(one(lm.perplexity(d, lm.ngram_counts(d)), "doc_id", "perplexity"))
    assert got[1] == pytest.approx(2.0642, abs=1e-3) and got[2] == pytest.approx(14 / 3) and got[3] == got[4] == math.inf
    assert dict(one(lm.perplexity_status(d, counts=lm.ngram_counts(d)), "doc_id", "status"))[3] == "perplexity_outlier"
    assert lm.ngram_counts(d.limit(0)).count() == 0


def test_pipeline_order_and_funnel(spark, docs):
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(70))
    rows = [(0, long(0), "en", "a"), (1, long(0) + " ...", "en", "a"), (2, long(2), "de", "a"), (3, long(3), "EN", "b"), (4, long(4), "en", "z"), (5, "few words", "en", "b"), (6, None, "en", "a"), (7, long(7), "en-GB", "b"), (8, "held out item", "en", "a")]
    rows.append((9, " ".join(["...", "word"] * 40), "en", "a"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, topic string")
    held = spark.createDataFrame([(1, "Held  OUT item")], "item_id bigint, text string")
    config = C.Config(topic_classes=("a", "b"), topic_distribution={"a": 0.5, "b": 0.5})
    run = pipeline.Curation(d, held, config, topic="topic")
    assert set(one(run.kept, "doc_id")) <= {0, 1, 3, 7} and len(set(one(run.kept, "doc_id")) & {0, 1}) <= 1
    steps = {r.phase: r.n_left for r in run.funnel().collect()}
    assert [steps[p] for p in ("input", "decontaminate", "sanitize", "language")] == [10, 8, 8, 7]
    assert steps["topics"] == 6 and steps["ellipsis"] == run.kept.count() >= steps["tokens"]
    by_topic = pipeline.Curation(d.drop("topic", "lang"), held, config, scorers={
        "language": lambda x: x.select("doc_id", F.lit("en").alias("lang"), F.when(F.col("doc_id") == 2, 0.5).otherwise(90.0).alias("lang_conf")),
        "topic": lambda x: x.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("topic")),
    })
    assert 2 not in one(by_topic.kept, "doc_id") and {r.phase: r.n_left for r in by_topic.funnel(False).collect()}["language"] == 7
    none = pipeline.Curation(d, held, C.Config(filter_mode="none", skip=frozenset({"dedup", "ellipsis", "tokens"})))
    assert [(r.phase, r.skipped) for r in none.funnel().orderBy("step").collect() if r.skipped] == [(p, True) for p in ("topics", "code", "quality", "dedup", "ellipsis", "tokens")]
    assert none.kept.count() == 7
    with pytest.raises(ValueError):
        pipeline.Curation(d, held, C.Config(skip=frozenset({"unheard"})))


def test_flat_verdicts(spark, docs):
    d = docs("some text", "x").withColumn("lang", F.lit("en"))
    plan = status.verdicts(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60


def test_checkpoints_are_dropped(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert stage.cut(spark.range(10)).count() == 10
        assert any(tmp_path.rglob("part-*"))
        stage.drop_checkpoints(spark)
        assert not any(tmp_path.rglob("part-*"))
    finally:
        spark.sparkContext.setCheckpointDir(before.removeprefix("file:") if before else str(tmp_path))


def test_word_tokens(spark, docs):
    assert one(packing.word_lengths(docs("a b", None)).orderBy("doc_id"), "n_tokens") == [3, 1]


def test_held_out_splits(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(str(tmp_path / "a"))
    with pytest.warns(UserWarning, match="'b'"):
        got = files.held_out(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert one(got, "item_id", "text", "split_name") == [(1, "x", "a")]
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        files.held_out(spark, {"b": str(tmp_path / "b")})


def test_char_overlap_alike(spark, docs):
    r = random.Random(9)
    texts = ["".join(r.choices("abcdé 😀", k=r.choice([5, 13, 14, 60]))) for _ in range(40)]
    d, items = docs(*texts, None, "", texts[3] * 3), docs(*(t[2:30] for t in texts[::3]), None, key="item_id")
    a, b = (sorted(map(tuple, decontaminate.char_overlap(d, items, limit).collect())) for limit in (10**6, 0))
    grams = lambda t: {t[k : k + 13] for k in range(len(t) - 12)}
    known = set().union(*(grams((t[2:30]).lower().strip()) for t in texts[::3]))
    assert a == b and [(n, m) for _, n, m, *_ in a] == [(len(grams(t)), len(grams(t) & known)) for t in ((t or "").lower().strip() for t in [*texts, None, "", texts[3] * 3])]
    assert decontaminate.char_overlap(d, items.limit(0)).where("n_matched > 0").count() == 0


def test_packing_of_real_tokens(spark, docs):
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    r = random.Random(12)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "naïve", "\n", "12"], k=r.randint(0, 60))) for _ in range(50)] + [None]
    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 50256] for x in texts]
    got = packing.tokenize(docs(*texts))
    assert dict(one(got, "doc_id", "input_ids")) == dict(enumerate(ids))
    lengths, n = got.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")), [len(x) for x in ids]
    assert dict(one(packing.offsets(lengths), "doc_id", "start")) == {k: sum(n[:k]) for k in range(len(n))}
    config, size, val = C.Config(context_length=31, val_ratio=0.2), 32, max(1, int(sum(n) * 0.2))
    owner = [k for k, x in enumerate(n) for _ in range(x)]
    want = {(s, k): (p[k * size], p[(k + 1) * size - 1], len(set(p[k * size : (k + 1) * size]))) for s, p in (("val", owner[:val]), ("train", owner[val:])) for k in range(len(p) // size)}
    assert {(a, b): c for a, b, *c in map(tuple, packing.chunks(lengths, config).select("split", "chunk", "first_doc", "last_doc", "n_docs").collect())} == {k: list(v) for k, v in want.items()}
    assert {s: (a, b) for s, a, b in one(packing.split(lengths, config), "split", "n_tokens", "n_chunks")} == {"val": (val, val // size), "train": (sum(n) - val, (sum(n) - val) // size)}
