"""Readers, writers and streams on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import decontaminate, packing
from lexmill.sources import files, sinks
from lexmill.streaming import tail

LOG = """2026-01-01 00:00:00 - INFO - t - step      0 | epoch 0 | loss 10.5 | lr 2.00e-05 | grad 3.5
2026-01-01 00:00:00 - DEBUG - t - step      0 | ppl 52.25 | dt 3.7s
2026-01-01 00:00:00 - INFO - t - Val:   loss=9.0, ppl=1.0
2026-01-01 00:00:01 - INFO - t - Starting evaluation...
2026-01-01 00:00:02 - INFO - t -   Train: loss=7.5, ppl=11.5
2026-01-01 00:00:02 - INFO - t -   Val:   loss=7.25, ppl=13.5
2026-01-01 00:00:02 - INFO - t -   ** New best validation loss! **
"""


def metric(step, kind="step", **more):
    return json.dumps({"stage": "s", "type": kind, "timestamp": f"2026-01-01T00:{step:02d}:00Z", "step": step, **more})


def test_metrics(spark, tmp_path):
    (tmp_path / "metrics.jsonl").write_text("\n".join([metric(0, train_loss=1.5), "", "{broken", "[1]", metric(25), metric(25, "eval", val_loss=2.0)]))
    got = files.run_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.type, r.step, r.train_loss, r.val_loss) for r in got] == [("step", 0, 1.5, None), ("step", 25, None, None), ("eval", 25, None, 2.0)]


def test_text_log(spark, tmp_path):
    (tmp_path / "train.log").write_text(LOG)
    got = [(r.type, r.step, r.loss, r.perplexity) for r in files.run_log(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("step", 0, 10.5, None), ("perplexity", 0, None, 52.25), ("eval_train", 0, 7.5, 11.5), ("eval", 0, 7.25, 13.5), ("best_checkpoint", 0, None, None)]
    with pytest.raises(FileNotFoundError):
        files.run_log(spark, str(tmp_path / "none"))


def test_config_and_label(tmp_path):
    yaml = pytest.importorskip("yaml")
    for text, error in (("", ValueError), ("- 1", ValueError)):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(error):
            files.config_file(str(tmp_path / "c.yaml"))
    with pytest.raises(FileNotFoundError):
        files.config_file(str(tmp_path / "none.yaml"))
    assert files.run_label(str(tmp_path)) == tmp_path.name
    (tmp_path / "config.json").write_text('{"training": {"learning_rate": 0.001}, "model": {"n_layers": 4}}')
    assert files.run_label(str(tmp_path)) == "lr=0.001, layers=4, d=?"
    sinks.best_params({"lr": 1, "d": 2}, {"d"}, str(tmp_path / "best.yaml"))
    assert yaml.safe_load((tmp_path / "best.yaml").read_text()) == {"model": {"d": 2}, "training": {"lr": 1}}
    with pytest.raises(ValueError):
        sinks.inside(str(tmp_path), "../x")


def test_token_file(spark, tmp_path):
    rows = [(5, [7, 8]), (1, [1, 2, 3]), (9, []), (2, [65535])]
    d = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>").repartition(3)
    path = str(tmp_path / "train.bin")
    assert sinks.token_file(d, path) == 6
    assert np.fromfile(path, np.uint16).tolist() == [1, 2, 3, 65535, 7, 8]
    chunks = files.token_chunks(spark, path, 3).orderBy("chunk")
    assert [list(r.input_ids) for r in chunks.collect()] == [[1, 2, 3], [65535, 7, 8]]
    assert [(list(r.x), list(r.y)) for r in files.windows(chunks).orderBy("chunk").collect()][0] == ([1, 2], [2, 3])


def test_corpus_and_subset(spark, tmp_path, docs):
    docs("a", "b").write.parquet(str(tmp_path / "documents.parquet"))
    assert files.corpus(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        files.corpus(spark, str(tmp_path), "huge")
    made = []
    make = lambda: made.append(1) or docs("a", "b", "c")
    assert files.cached_subset(spark, str(tmp_path), 10, 1, make).count() == files.cached_subset(spark, str(tmp_path), 10, 1, make).count() == 3
    assert made == [1]


def test_sinks(spark, tmp_path, docs):
    sinks.lines(docs("a\nb", " ", None), "text", str(tmp_path / "lm"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lm")).collect()] == ["a b"]
    for _ in range(2):
        sinks.append_metrics(docs("a"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def run_stream(stream, spark, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([metric(k, train_loss=float(k)) for k in range(6)] + ["{bad"] + [metric(10 + k, "eval", val_loss=float(k)) for k in range(5)]))
    s = tail.metric_stream(spark, str(tmp_path / "in"))
    got = run_stream(tail.windowed_loss(s), spark, "loss", "complete")
    assert sorted((r.n, r.mean_loss) for r in got) == [(1, 5.0), (5, 2.0)]
    got = run_stream(tail.early_stops(s, 3), spark, "stops", "append")
    assert [(r.stage, r.step) for r in got] == [("s", 13)]


def test_stream_curation(spark, tmp_path):
    long = " ".join(f"word{k} something{k}" for k in range(60))
    rows = [(1, long, "en"), (2, "short", "en"), (3, long.replace("word", "term"), "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    stream = spark.readStream.schema("doc_id bigint, text string, lang string").parquet(str(tmp_path / "in"))
    tail.curate(stream, decontaminate.index_of(held), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect()] == [3]
