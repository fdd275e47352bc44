"""Ordered heuristic filters; each is a status column, 'kept' or the first rule that failed, cheap rules first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.labels import normal_label


def code_status(c: Column) -> Column:
    c = T.text(c)
    return (
        F.when(c.contains("```"), "code_fence")
        .when(T.html_density(c) > C.MAX_HTML, "html_density")
        .when(T.symbol_ratio(c) > C.MAX_SYMBOLS, "symbol_ratio")
        .when(T.keyword_count(c) > C.MAX_KEYWORDS, "keyword_density")
        .otherwise("kept")
    )


def quality_status(c: Column) -> Column:
    c = T.text(c)
    return T.let(
        T.words(c),
        lambda w: F.when(F.size(w) < C.MIN_WORDS, "too_few_words")
        .when(F.length(c) < C.MIN_CHARS, "too_few_chars")
        .when(T.longest(w) > C.MAX_WORD, "unnatural_word")
        .when(T.repeats(w) > C.MAX_REPEATS, "ngram_repetition")
        .otherwise("kept"),
    )


def ellipsis_status(c: Column) -> Column:
    c = T.text(c)
    n = T.count(c, T.ELLIPSIS)
    return F.when((n > 0) & (n / F.greatest(F.size(T.words(c)), F.lit(1)) > C.MAX_ELLIPSIS), "excessive_ellipsis").otherwise("kept")


def sanitize_status(c: Column) -> Column:
    """Status of the sanitized text c."""
    return F.when(c == "", "empty_after_clean").when(T.looks_like_code(c), "code_snippet").otherwise("kept")


def sanitized(df: DataFrame) -> DataFrame:
    """doc_id, the sanitized text ('' for rows that fail) and its status."""
    s = df.select("doc_id", T.sanitize(T.text(F.col("text"))).alias("clean"))
    s = s.withColumn("status", sanitize_status(F.col("clean")))
    return s.select("doc_id", F.when(F.col("status") == "kept", F.col("clean")).otherwise("").alias("clean_text"), "status")


PHASES = ("sanitize", "language", "code", "quality", "ellipsis")


def known_language(lang: Column, confidence: Column | None, config: C.Config) -> Column:
    """'kept' for the language of config in any notation, with its confidence or more if one is given (percents are read as shares), else 'other_language'."""
    known = normal_label(lang) == config.language
    if confidence is not None:
        known = known & (F.when(confidence > 1, confidence / 100).otherwise(confidence) >= config.min_confidence)
    return F.when(F.coalesce(known, F.lit(False)), "kept").otherwise("other_language")


def first_failure(phases: dict[str, Column]) -> Column:
    """(phase, reason) of the first status column that isn't 'kept', else ('kept', 'kept'). Each is looked at once, those after it not at all."""
    failed = [T.let(s, lambda x, p=p: F.when(x != "kept", F.struct(F.lit(p).alias("phase"), x.alias("reason")))) for p, s in phases.items()]
    return F.coalesce(*failed, F.struct(F.lit("kept").alias("phase"), F.lit("kept").alias("reason")))


def row_phases(clean: Column, lang: Column, confidence: Column | None, config: C.Config) -> dict[str, Column]:
    """Status column of each phase of PHASES that config doesn't skip, for a sanitized text. In other filter modes than heuristic, code and quality are left out."""
    every = {
        "sanitize": sanitize_status(clean), "language": known_language(lang, confidence, config), "code": code_status(clean), "quality": quality_status(clean),
        "ellipsis": ellipsis_status(clean),
    }
    left_out = set(config.skip) | (set() if config.filter_mode == "heuristic" else {"code", "quality"})
    return {p: s for p, s in every.items() if p not in left_out}


def verdicts(df: DataFrame, config: C.Config | None = None) -> DataFrame:
    """doc_id and the first phase that drops the document with its reason; one pass, phases after the first failure aren't looked at.

    df: doc_id, text, lang and, if given, lang_conf, which must be config.min_confidence or more. A null lang is no language.
    Phases in config.skip are left out; the verdicts of models are in plans.pipeline.
    """
    config = config or C.Config()
    if config.filter_mode == "classifier":
        raise ValueError("verdicts by models: only plans.pipeline has the classifier mode")
    confidence = F.col("lang_conf") if "lang_conf" in df.columns else F.lit(None).cast("double")
    s = df.select("doc_id", F.col("lang").alias("lang"), confidence.alias("conf"), T.sanitize(T.text(F.col("text"))).alias("clean"))
    conf = F.col("conf") if "lang_conf" in df.columns else None
    v = T.let(F.col("clean"), lambda c: first_failure(row_phases(c, F.col("lang"), conf, config)))
    return s.select("doc_id", v.alias("v")).select("doc_id", "v.phase", "v.reason")


def funnel(df: DataFrame, config: C.Config | None = None) -> DataFrame:
    """Documents left after each phase, from one pass over the documents."""
    config = config or C.Config()
    spark = df.sparkSession
    gone = verdicts(df, config).groupBy("phase").agg(F.count("*").alias("n"))
    steps = spark.createDataFrame([(0, "input", False), *((k + 1, p, p in config.skip) for k, p in enumerate(PHASES))], "step int, phase string, skipped boolean")
    total = gone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = steps.join(gone, "phase", "left").crossJoin(F.broadcast(total))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row a phase
    return rows.select("step", "phase", "skipped", (F.col("total") - F.sum(F.coalesce("n", F.lit(0))).over(upto)).alias("n_left"))
