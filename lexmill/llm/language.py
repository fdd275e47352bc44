"""Problem 3: language of records and of their stretches, by word-first backoff.

For each word the model has per-language log frequencies; a word it hasn't seen is scored by its character 5-grams, if
none of these is known by 4-grams, and so on down to single characters. Words add up to sentences, and a record's
sentences are labelled together: the best path pays SWITCH for each change of language. A class for text in no language
(made-up Latin, strings) competes too, and words that even short n-grams don't explain count for it.

The model is fitted on at most SAMPLE records for each label, taken in the order of a hash, and refitted ROUNDS times
on the sentences as it labels them itself, so that wrong labels and mixed records wash out. Everything else covers all
records.

Records with null or blank text have no language. Of several labels of a record that with the latest detected_at is
current (ties: higher lang_conf, then the greater lang). Notations of one language are the same label.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.labels import normal_label
from lexmill.llm.common import map_texts

# Fixed value: the languages.
LANGUAGES = ("en", "de", "fr", "es", "it", "nl")
# Fixed value: the usual filler text.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat"

CLASSES = (*LANGUAGES, "none")
NONE = len(LANGUAGES)
SAMPLE, ROUNDS = 400, 2
ORDER, SWITCH, LEAST_SHARE, LEAST_WORDS = 5, 5.0, 0.2, 3
TOKEN = re.compile(r"[^\W_]+|[.!?…][\"'”»)\]]*(?=\s)|\n")


def current_labels(labels: DataFrame) -> DataFrame:
    """(row_id, label): the current label of each record with a row, normalised."""
    last = F.max_by(F.struct("lang"), F.struct("detected_at", "lang_conf", "lang"))
    return labels.groupBy("row_id").agg(last.alias("l")).select("row_id", normal_label(F.col("l.lang")).alias("label"))


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def sentences(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens:
        if t[0].isalnum():
            out[-1].append(t)
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


class Model:
    """Log frequencies of words and n-grams for each class."""

    def __init__(self, counts: list[Counter]):
        # Records of real languages with a wrong label must not teach what made-up text looks like.
        own = {w: n for w, n in counts[NONE].items() if n > sum(c[w] for c in counts[:NONE])}
        counts = [*counts[:NONE], Counter(own)]
        self.common = [frozenset(w for w, _ in c.most_common(150)) for c in counts]
        vocab = {w for c in counts for w, n in c.items()}
        #: Words seen more than by chance.
        self.vocabulary = frozenset(w for w in vocab if sum(c[w] for c in counts[:NONE]) > 0 or counts[NONE][w] > 4)
        total = [sum(c.values()) for c in counts]
        a = 0.1
        self.words = {w: np.array([math.log((c[w] + a) / (t + a * len(vocab) + 1)) for c, t in zip(counts, total)], np.float32) for w in vocab}
        self.grams: list[dict] = [{} for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            per = []
            for c in counts:
                g: Counter = Counter()
                for w, k in c.items():
                    for x in grams(w, n):
                        g[x] += min(k, 3)
                per.append(g)
            seen = set().union(*per)
            if n == 1:
                # What the languages' words seldom hold speaks for no language.
                per[NONE] = Counter({x: max(1, sum(p[x] for p in per) // 50) for x in seen})
            size = [sum(p.values()) for p in per]
            self.grams[n] = {x: np.array([math.log((p[x] + 0.5) / (s + 0.5 * len(seen) + 1)) for p, s in zip(per, size)], np.float32) for x in seen if n < 4 or sum(p[x] for p in per) > 1}
        self.strange = np.full(len(CLASSES), -12, np.float32)
        self.strange[NONE] = -9

    def score(self, word: str) -> np.ndarray:
        """Log score of the word for each class; levelled so that no single word decides alone."""
        v = self.words.get(word)
        if v is None:
            if any(ch.isdigit() for ch in word):
                v = np.zeros(len(CLASSES), np.float32)
                if not word.isdigit():
                    v = v.copy()
                    v[NONE] += 1.5
                return v
            v = self.strange
            for n in range(ORDER, 0, -1):
                known = [g for g in (self.grams[n].get(x) for x in grams(word, n)) if g is not None]
                if known:
                    v = np.mean(known, axis=0) * (1.0 if n > 2 else 0.5)
                    if n <= 3:
                        v = v.copy()
                        v[NONE] += 0.7 * (4 - n)
                    break
        return np.maximum(v - v.max(), -6.0)


class Labeller:
    """Labels batches of texts; remembers the scores of words, as many as fit."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(CLASSES)), np.float32)
        self.n = 0

    def index(self, t: str) -> int:
        k = self.at.get(t)
        if k is None:
            if t[0].isalnum():
                k = self.n
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.model.score(t)
                self.n += 1
            else:
                k = -1
            self.at[t] = k
        return k

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """For each text its stretches (class, first word, words, confidence)."""
        if self.n > 300_000:
            self.reset()
        lists = [TOKEN.findall(t.lower()) for t in texts]
        lens = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        look, at = self.index, self.at
        ids = np.fromiter((at[t] if t in at else look(t) for x in lists for t in x), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(lists)), lens)
        word = ids >= 0
        # A sentence starts at a word whose neighbour before is a break or in another text.
        before = np.concatenate([[False], word[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]])
        first = np.flatnonzero((word & ~before)[word])
        ids, owner = ids[word], owner[word]
        out: list[list] = [[] for _ in texts]
        if not len(ids):
            return out
        sums = np.add.reduceat(self.rows[ids], first, axis=0)
        size = np.diff(np.append(first, len(ids)))
        whose = owner[first]
        best = sums.argmax(1)
        cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
        total = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            path = best[a:b]
            if (path != path[0]).any():
                path = self.path(sums[a:b])
            edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), b - a]):
                s, c = sums[a + i : a + j].sum(0), int(path[i])
                n = int(size[a + i : a + j].sum())
                rest = np.delete(s, c).max()
                out[k].append((c, int(first[a + i] - total[k]), n, float(1 / (1 + math.exp(-min(50.0, max(-50.0, (s[c] - rest) / math.sqrt(n))))))))
        return out

    @staticmethod
    def path(sums: np.ndarray) -> np.ndarray:
        score, back = sums[0].copy(), []
        for row in sums[1:]:
            jump = int(score.argmax())
            stay = score >= score[jump] - SWITCH
            back.append(np.where(stay, np.arange(len(row)), jump))
            score = np.maximum(score, score[jump] - SWITCH) + row
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])


def fit(texts: list[tuple[str, str]]) -> Model:
    """Model from (label, text) pairs; labels are CLASSES."""
    counts = [Counter() for _ in CLASSES]
    lists = [(CLASSES.index(c), sentences(TOKEN.findall(t.lower()))) for c, t in texts]
    for c, ss in lists:
        for s in ss:
            counts[c].update(w for w in s if w.isalpha() or not any(ch.isdigit() for ch in w))
    seed = Counter(FILLER.split())
    counts[NONE].update(seed)
    model = Model(counts)
    for _ in range(ROUNDS):
        label = Labeller(model)
        counts = [Counter() for _ in CLASSES]
        counts[NONE].update(seed)
        for (_, text), (_, ss) in zip(texts, lists):
            words = [w for s in ss for w in s]
            for c, at, n, _ in label.label([text])[0]:
                counts[c].update(w for w in words[at : at + n] if w.isalpha() or not any(ch.isdigit() for ch in w))
        model = Model(counts)
    return model


def sample_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(row_id, label) of at most `sample` records for each label, by a hash."""
    now = current_labels(labels).where(F.col("label").isin(*CLASSES))
    order = Window.partitionBy("label").orderBy(F.xxhash64("row_id"), "row_id")
    return now.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("row_id", "label")


def train(records: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most `sample` records for each label."""
    return train_on(records, sample_ids(labels, sample))


def train_on(records: DataFrame, ids: DataFrame) -> Model:
    """Model from the records of a bounded frame (row_id, label)."""
    rows = records.select("row_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "row_id").orderBy("row_id", "text").limit(SAMPLE * len(CLASSES) * 2).collect()
    return fit([(r.label, r.text) for r in rows])


def segments(records: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(row_id, segment, lang, first_word, n_words, confidence): the stretches of each record; lang 'none' for no language."""
    shared = records.sparkSession.sparkContext.broadcast(model or train(records, labels))

    def make():
        lab = Labeller(shared.value)

        def f(ids, texts):
            rows = [(i, k, CLASSES[c], at, n, p) for i, ss in zip(ids, lab.label(texts)) for k, (c, at, n, p) in enumerate(ss)]
            return {name: [r[j] for r in rows] for j, name in enumerate(("row_id", "segment", "lang", "first_word", "n_words", "confidence"))}

        return f

    return map_texts(records, "row_id bigint, segment int, lang string, first_word int, n_words int, confidence double", make, "row_id", "text")


def languages(records: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(row_id, lang, share, confidence): each language that makes up at least LEAST_SHARE of the record's words, and LEAST_WORDS of them."""
    shared = records.sparkSession.sparkContext.broadcast(model or train(records, labels))

    def make():
        lab = Labeller(shared.value)

        def f(ids, texts):
            rows = []
            for i, ss in zip(ids, lab.label(texts)):
                total, per = sum(s[2] for s in ss), defaultdict(lambda: [0, 0.0])
                for c, _, n, p in ss:
                    per[c][0] += n
                    per[c][1] += n * p
                rows += [(i, CLASSES[c], n / total, p / n) for c, (n, p) in sorted(per.items()) if c != NONE and n >= max(LEAST_WORDS, LEAST_SHARE * total)]
            return {name: [r[j] for r in rows] for j, name in enumerate(("row_id", "lang", "share", "confidence"))}

        return f

    return map_texts(records, "row_id bigint, lang string, share double, confidence double", make, "row_id", "text")


def found(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, lang) of the records in two languages, or in one that isn't their current label."""
    per = languages(records, labels).groupBy("row_id").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    both = per.join(current_labels(labels), "row_id", "left")
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0])
    return both.where(case).select("row_id", F.explode("langs").alias("lang")).distinct()
