"""Problem 4: per-document text quality statistics, and which form a record has, by robust Mahalanobis distance.

Each record gets the statistics STATS. Per language, mean and covariance of prose are estimated robustly over all
records: the start is median and MAD, then STEPS concentration steps each take the moments of the records within CUT of
the last estimate. A record's squared distance splits into one part per statistic (z * inverse covariance * z), which
tells why it is no prose. Only records beyond FAR have a form. The evidence for each form is the sum of the parts of the
statistics it shows in (EVIDENCE); the form with most evidence is taken if that is beyond what nearly all records within
FAR have for it (LEAST, fitted on the distribution of the parts) and the record is what the form's definition says: two
thirds of the characters in short entries, rows with the same fields, or strings instead of words. What is usual in a
language so is no form there: where all prose stands in short lines, short lines make no list.

Common words of a language and the known words come from the language model (llm.language), fitted on a bounded sample.
Null, empty and blank texts have statistics of zero and no form.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import language
from lexmill.llm.common import map_texts, words_of
from lexmill.plans.stage import cut

STATS = ("log_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "entry_share", "row_share", "unknown_share")
#: Least standard deviation of each statistic, so that one that hardly varies in prose doesn't rule alone.
FLOOR = np.array([0.5, 0.35, 0.03, 0.15, 0.06, 0.08, 0.05, 0.05])
CUT, FAR, STEPS = 20.09, 26.12, 2  # chi-square with 8 degrees of freedom: 0.99, 0.999
LIST_SHARE, ROW_SHARE, JUNK_SHARE, JUNK_WORDS = 2 / 3, 0.6, 0.85, 0.03
ENTRY_CHARS, ENTRY_WORDS = 80, 9
#: Statistics whose parts speak for each form.
EVIDENCE = {
    "junk": ("unknown_share", "common_share", "symbol_ratio", "mean_word_length"), "table": ("row_share", "entry_share"), "list": ("entry_share", "punct_line_share"),
}
FORMS = tuple(EVIDENCE)
WEIGHTS = np.array([[c in of for of in EVIDENCE.values()] for c in STATS], float)
LEAST = 0.999
END = re.compile(r"[.!?…][\"'”»)\]*_]*$")
#: What may split fields: a tab, wide gaps, ; or , or a bar of any kind, any other sign between blanks.
SEPARATOR = re.compile(r"\t| {2,}|[;,|¦│┃║‖︱｜]| [^\w\s.…!?\"'()\[\]%$€£&+\-–—] ")
LOOSE = ("\t", "  ")
BARS = "|¦│┃║‖︱｜"

SCHEMA = "row_id bigint, lang string, n_words bigint, n_known bigint, n_lines bigint, x array<double>"


def lines_of(text: str) -> list[str]:
    return [s for s in (x.strip("\r\n\v\f\x85   \xa0﻿") for x in text.splitlines()) if s.strip()]


def row_share(lines: list[str]) -> float:
    """Share of the lines' characters in rows with the same three or more fields; 0 with fewer than three rows."""
    best = 0.0
    if len(lines) < 3:
        return best
    size = sum(map(len, lines))
    found = [Counter("  " if m.isspace() and m != "\t" else m.strip(" ") for m in SEPARATOR.findall(x)) for x in lines]
    for sep in set().union(*found):
        n = [c[sep] for c in found]
        mode, rows = Counter(k for k in n if k > 1).most_common(1)[0] if any(k > 1 for k in n) else (0, 0)
        if rows < 3:
            continue
        # Fields are short; sentences with as many commas aren't rows.
        near = [x for x, k in zip(lines, n) if abs(k - mode) <= (2 if sep in LOOSE or sep in BARS else 0)]
        if sum(len(x.split()) for x in near) <= 4 * (mode + 1) * len(near) and sum(bool(END.search(x)) for x in near) <= 0.3 * len(near):
            best = max(best, sum(map(len, near)) / size)
    return best


def entry_share(lines: list[str]) -> float:
    """Share of the lines' characters in short lines that are no sentences; 0 with fewer than three of them."""
    short = [x for x in lines if len(x) <= ENTRY_CHARS and not END.search(x) and len(x.split()) <= ENTRY_WORDS + 2]
    return sum(map(len, short)) / sum(map(len, lines)) if len(short) >= 3 else 0.0


class Words:
    """For each word, in which languages it is common, whether it is a known word of three letters or more, and its length if so."""

    def __init__(self, model: language.Model):
        self.common = [model.common[k] for k in range(language.NONE)]
        self.words = model.vocabulary
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.common) + 2), np.float32)

    def index(self, w: str) -> int:
        k = len(self.at)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = len(w) > 2 and w in self.words
        self.rows[k] = [*(w in c for c in self.common), known, len(w) * known]
        self.at[w] = k
        return k


def statistics(records: DataFrame, model: language.Model) -> DataFrame:
    """SCHEMA for each record: language by common words, counts, and STATS as x."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    def make():
        ws = Words(shared.value)

        def f(ids, texts):
            if len(ws.at) > 300_000:
                ws.__init__(shared.value)
            lists = [words_of(t) for t in texts]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            at, index = ws.at, ws.index
            flat = np.fromiter((at[w] if w in at else index(w) for x in lists for w in x), np.int64, int(n.sum()))
            sums = np.zeros((len(lists), ws.rows.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(ws.rows[flat], (np.cumsum(n) - n)[some], axis=0)
            x = np.zeros((len(texts), len(STATS)))
            n_lines = []
            for k, (t, w) in enumerate(zip(texts, lists)):
                lines = lines_of(t)
                n_lines.append(len(lines))
                if not lines:
                    continue
                letters, solid = sum(map(len, w)), len("".join(t.split()))
                x[k] = (0, letters / max(1, len(w)), (solid - letters) / max(1, solid), sum(bool(END.search(s)) for s in lines) / len(lines), 0, entry_share(lines), row_share(lines), 1 - min(1.0, sums[k, -1] / max(1, solid)))
            x[:, 0], x[:, 4] = np.log1p(n), sums[:, :-2].max(1) / np.maximum(n, 1)
            lang = np.where(x[:, 4] > 0.04, np.array(language.LANGUAGES)[sums[:, :-2].argmax(1)], "none")
            return {"row_id": ids, "lang": lang.tolist(), "n_words": n, "n_known": sums[:, -2].astype(np.int64), "n_lines": n_lines, "x": list(x)}

        return f

    return map_texts(records.withColumn("text", F.coalesce("text", F.lit(""))), SCHEMA, make, "row_id", "text")


def inverse(c: np.ndarray) -> np.ndarray:
    """Inverse covariance, with a deviation of FLOOR at least in every direction."""
    values, axes = np.linalg.eigh(c / np.outer(FLOOR, FLOOR))
    return (axes / np.maximum(values, 1)) @ axes.T / np.outer(FLOOR, FLOOR)


class Shape:
    """Mean and inverse covariance for each language; a pooled one for the rest."""

    def __init__(self, parts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.parts = {k: (m, inverse(c)) for k, (m, c) in parts.items()}

    def split(self, lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Parts of the squared distance by statistic."""
        out = np.zeros_like(x)
        for k in set(lang.tolist()):
            m, inv = self.parts.get(k) or self.parts[""]
            z = x[lang == k] - m
            out[lang == k] = z * (z @ inv)
        return out


def fit_shape(stats: DataFrame) -> Shape:
    """Robust prose mean and covariance over all records with words."""
    d, sc = len(STATS), stats.sparkSession.sparkContext
    prose = stats.where("n_words >= 20 and lang <> 'none'").select("lang", "x")
    spread = [F.percentile_approx(F.col("x")[j], [0.25, 0.5, 0.75], 1000).alias(f"q{j}") for j in range(d)]
    start = {r.lang: np.array([r[f"q{j}"] for j in range(d)]) for r in prose.groupBy("lang").agg(*spread).collect()}
    whole = prose.agg(*spread).first()
    start[""] = np.array([whole[f"q{j}"] or [0.0] * 3 for j in range(d)])
    shape = Shape({k: (q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)) for k, q in start.items()})
    for _ in range(STEPS):
        now = sc.broadcast(shape)

        def moments(batches):
            import pyarrow as pa

            for b in batches:
                lang = np.array(b.column(0).to_pylist())
                x = np.array(b.column(1).to_pylist()).reshape(-1, d)
                near = now.value.split(lang, x).sum(1) <= CUT
                for k in set(lang[near].tolist()):
                    y = x[near & (lang == k)]
                    m = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
                    yield pa.RecordBatch.from_pydict({"lang": [k], "m": [m.tolist()]})

        sums = prose.mapInArrow(moments, "lang string, m array<double>").groupBy("lang").agg(*[F.sum(F.col("m")[j]).alias(f"m{j}") for j in range(1 + d + d * d)])
        got = {r.lang: np.array(r[1:], float) for r in sums.collect()}
        if not got:
            break
        got[""] = np.sum(list(got.values()), axis=0)
        parts = {}
        for k, v in got.items():
            if v[0] >= 3 * d or k == "":
                m = v[1 : 1 + d] / v[0]
                parts[k] = (m, v[1 + d :].reshape(d, d) / v[0] - np.outer(m, m))
        shape = Shape(parts)
    return shape


def fit_least(stats: DataFrame, shape: Shape) -> np.ndarray:
    """For each form the evidence that a share LEAST of the records within FAR doesn't exceed; over all records, by percentiles."""
    shared = stats.sparkSession.sparkContext.broadcast(shape)

    def near(batches):
        import pyarrow as pa

        for b in batches:
            parts = shared.value.split(np.array(b.column(0).to_pylist()), np.array(b.column(1).to_pylist()).reshape(-1, len(STATS)))
            e = (parts @ WEIGHTS)[parts.sum(1) <= FAR]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in e.T], names=list(FORMS))

    rows = stats.where("n_lines > 0").select("lang", "x").mapInArrow(near, ", ".join(f"{f} double" for f in FORMS))
    got = rows.agg(*(F.percentile_approx(f, LEAST, 10_000).alias(f) for f in FORMS)).first()
    return np.array([got[f] or 0.0 for f in FORMS])


def form_of(x: np.ndarray, parts: np.ndarray, n_words: int, n_known: int, least: np.ndarray) -> str | None:
    """The form with most evidence in the parts of an outlier's distance, if the record meets its definition."""
    if parts.sum() <= FAR:
        return None
    evidence = parts @ WEIGHTS
    k = int(evidence.argmax())
    if evidence[k] <= least[k]:
        return None
    meets = {"junk": x[7] >= JUNK_SHARE and n_known <= max(2, JUNK_WORDS * n_words), "table": x[6] >= ROW_SHARE, "list": x[5] >= LIST_SHARE}
    return FORMS[k] if meets[FORMS[k]] else None


def measured(records: DataFrame, labels: DataFrame, model: language.Model | None = None) -> DataFrame:
    """(row_id, lang, n_words, n_lines, STATS..., distance, a part for each of STATS, form)."""
    stats = cut(statistics(records, model or language.train(records, labels)))
    fitted = fit_shape(stats)
    least = fit_least(stats, fitted)
    shape = stats.sparkSession.sparkContext.broadcast(fitted)
    head = "row_id bigint, lang string, n_words bigint, n_lines bigint, "
    schema = head + ", ".join(f"{c} double" for c in STATS) + ", distance double, " + ", ".join(f"part_{c} double" for c in STATS) + ", form string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            lang, n, known = np.array(b.column(1).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist()
            x = np.array(b.column(5).to_pylist()).reshape(-1, len(STATS))
            parts = shape.value.split(lang, x)
            form = [form_of(x[k], parts[k], n[k], known[k], least) if b.column(4)[k].as_py() else None for k in range(len(n))]
            cols = [b.column(0), b.column(1), b.column(2), b.column(4), *map(pa.array, x.T), pa.array(parts.sum(1)), *map(pa.array, parts.T), pa.array(form, pa.string())]
            names = ["row_id", "lang", "n_words", "n_lines", *STATS, "distance", *(f"part_{c}" for c in STATS), "form"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return stats.mapInArrow(run, schema)


def found(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, form) of lists, tables and junk."""
    return measured(records, labels).where(F.col("form").isNotNull()).select("row_id", "form").distinct()
