"""The whole curation as one plan: decontamination, sanitizing, language, topics, code, quality, near-duplicates, ellipses, tokens, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.operators import classify, decontaminate, dedup, lm, packing, sampling, status
from lexmill.plans.stage import cut, left_join

PHASES = ("decontaminate", "sanitize", "language", "topics", "code", "quality", "dedup", "ellipsis", "tokens")
Scorer = Callable[[DataFrame], DataFrame]


class Curation:
    """One run over documents (doc_id, text, lang and, if given, lang_conf and the topic column).

    Between two phases that need the whole (resampling, near-duplicates) all row-wise ones are one pass, which is cut: each
    document with the first phase that drops it. A phase in config.skip, or one without what it needs (topics without a topic,
    code and quality in filter mode none), is left out. In filter mode classifier, models has those of classify.train for
    "code" and "education", and may have lm.ngram_counts as "ngrams" (else the unigrams of what is left serve); they and the
    perplexity decide. scorers may give "language": (doc_id, text) -> (doc_id, lang,
    lang_conf) in place of the columns, and "topic": (doc_id, text) -> (doc_id, topic).
    """

    def __init__(self, documents: DataFrame, held_out: DataFrame, config: C.Config | None = None, topic: str | None = None, models: dict | None = None, scorers: dict[str, Scorer] | None = None):
        self.config = config = config or C.Config()
        scorers = scorers or {}
        if unknown := set(config.skip) - set(PHASES):
            raise ValueError(f"no such phases: {sorted(unknown)}")
        by_model = config.filter_mode == "classifier"
        needed = {m for phase, m in (("code", "code"), ("quality", "education")) if by_model and phase not in config.skip}
        if missing := needed - set(models or {}):
            raise ValueError(f"filter mode classifier needs models: {sorted(missing)}")
        self.skipped = set(config.skip) | ({"code", "quality"} if config.filter_mode == "none" else set())
        if not topic and "topic" not in scorers:
            self.skipped.add("topics")
        #: Documents dropped by each phase, as (phase, number) rows or a number left; read by funnel().
        self._tallies: list[DataFrame] = []
        self._left: dict[str, DataFrame] = {}

        columns = ["doc_id", *([topic] if topic and "topic" not in scorers else [])]
        given = [c for c in ("lang", "lang_conf") if c in documents.columns and "language" not in scorers]
        d = documents.select(*columns, *given, T.text(F.col("text")).alias("text"))
        first = {}
        if "decontaminate" not in self.skipped:
            d = left_join(d.withColumn("_fp", decontaminate.fingerprint(F.col("text"))), decontaminate.index_of(held_out).select(F.col("fp").alias("_fp"), F.lit(True).alias("_hit")), ["_fp"])
            first["decontaminate"] = lambda c: F.when(F.col("_fp").isNull(), "empty_after_normalize").when(F.col("_hit"), "test_overlap").otherwise("kept")
        hit = [c for c in ("_fp", "_hit") if c in d.columns]
        if "sanitize" not in self.skipped:
            d = d.select(*columns, *given, *hit, T.sanitize(F.col("text")).alias("text"))
            first["sanitize"] = status.sanitize_status
        if "language" not in self.skipped:
            if "language" in scorers:
                d = self._pass(d, columns, first)
                d, first = d.join(scorers["language"](d.select("doc_id", "text")), "doc_id", "left"), {}
            conf = F.col("lang_conf") if "lang_conf" in d.columns else None
            first["language"] = lambda c: status.known_language(F.col("lang"), conf, config)
        d = self._pass(d, columns, first)
        if "topics" not in self.skipped:
            if "topic" in scorers:
                topic = "topic"
                d = d.join(cut(scorers["topic"](d.select("doc_id", "text")).select("doc_id", "topic")), "doc_id")
            d = sampling.topic_resample(d, config, topic)
        if needed:
            d = self._left["topics"] = cut(d.select("doc_id", "text"))
            if "code" in needed:
                d = self._left["code"] = cut(_kept(d, classify.code_filter(d, models["code"])))
            if "education" in needed:
                d = self._left["quality"] = cut(_kept(_kept(d, lm.perplexity_status(d, counts=models.get("ngrams"))), classify.education_filter(d, models["education"])))
        else:
            every = {"code": status.code_status, "quality": status.quality_status}
            d = self._pass(d.select("doc_id", "text"), ["doc_id"], {p: f for p, f in every.items() if p not in self.skipped}, "topics")
        if "dedup" not in self.skipped:
            d = dedup.verified_survivors(d)
        self._left["dedup"] = d
        if "ellipsis" not in self.skipped:
            d = d.where(status.ellipsis_status(F.col("text")) == "kept")
        #: (doc_id, text) of what passes; the text is sanitized.
        self.kept = self._left["ellipsis"] = d

    def _pass(self, d: DataFrame, columns: list[str], phases: dict[str, Callable], before: str | None = None) -> DataFrame:
        """(columns, text) of the rows that no phase drops; the pass is cut."""
        v = T.let(F.col("text"), lambda c: status.first_failure({p: f(c) for p, f in phases.items()}))
        judged = d.select(*columns, "text", v["phase"].alias("phase"))
        judged = cut(judged.select(*columns, "phase", F.when(F.col("phase") == "kept", F.col("text")).alias("text")))
        self._tallies.append(judged)
        if before:
            self._left[before] = judged
        return judged.where("phase = 'kept'").select(*columns, "text")

    def tokens(self) -> DataFrame:
        """(doc_id, input_ids, n_tokens) of the curated documents with at least min_tokens tokens, the end mark included."""
        return packing.tokenize(self.kept) if "tokens" in self.skipped else tokens(self.kept, self.config)

    def funnel(self, tokens: bool = True) -> DataFrame:
        """(step, phase, skipped, n_left): the documents left after each phase; a skipped one leaves what was there before it. tokens: with the last phase."""
        gone: dict[str, int] = {}
        for judged in self._tallies:
            for r in judged.groupBy("phase").count().collect():  # a row a phase
                gone[r.phase] = gone.get(r.phase, 0) + r["count"]
        n = self._tallies[0].count()
        rows = [(0, "input", False, n)]
        for k, p in enumerate(PHASES if tokens else PHASES[:-1]):
            if p in self._left and p not in ("dedup", "ellipsis"):
                n = self._left[p].count()
            elif p == "ellipsis" or (p == "dedup" and p not in self.skipped):
                n = self._left[p].count() if p not in self.skipped else n
            elif p == "tokens":
                n = self.tokens().count() if p not in self.skipped else n
            else:
                n -= gone.get(p, 0)
            rows.append((k + 1, p, p in self.skipped, n))
        return self.kept.sparkSession.createDataFrame(rows, "step int, phase string, skipped boolean, n_left bigint")


def curate(documents: DataFrame, held_out: DataFrame, config: C.Config | None = None, topic: str | None = None, models: dict | None = None, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """(doc_id, text) of the documents that pass all phases; see Curation."""
    return Curation(documents, held_out, config, topic, models, scorers).kept


def tokens(curated: DataFrame, config: C.Config | None = None) -> DataFrame:
    """(doc_id, input_ids, n_tokens) of curated documents with at least min_tokens tokens, the end mark included."""
    t = packing.tokenize(curated)
    return t.where(F.col("n_tokens") >= (config or C.Config()).min_tokens)


def _kept(d: DataFrame, verdicts: DataFrame) -> DataFrame:
    return d.join(verdicts.where("status = 'kept'").select("doc_id").distinct(), "doc_id", "left_semi")
