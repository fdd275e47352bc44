"""Problem 5: template residue and error-page text, by positive-unlabelled naive Bayes fitted with expectation-maximization.

Two models of the same kind work on two kinds of units:

* passages (sentences and lines), as bags of words, for filler, error messages and script notices; content of
  each language is weighted as if that language were as frequent in it as in residue, so that words don't count for their
  language, and the COMMON most frequent words (at most a twentieth of all) are left out;
* slots (marks such as {{name}} or [Your name here]), as bags of their shape, inner words and neighbours; a mark
  in quotes or code ticks is talked about and is none.

Trusted are the passages of records of whose letters more than TRUST stand in passages with a sign (SIGNS), and marks of
well-known shapes (TRUSTED). All other units are unlabelled: passages start as content, marks as most likely residue, and each round
gives every unlabelled unit its probability of being residue and refits both classes with it, while trusted units stay
residue. The fit uses at most SAMPLE distinct texts with a sign, as many with a mark, and as many of all, those of least hash
among all records; scoring covers all records.

Passages of a record belong together: a residue record has residue passages with probability INSIDE, another one with
probability OUTSIDE (a quoted or a last line), and the share of residue records is fitted too. All passages of a record
give the odds that it is one, and with these each passage is decided, in the fit as in scoring. A record is residue if a slot stands in it
bare, or if residue passages hold more than half of its letters. Numbers and trace codes count for neither side. Null,
empty and blank texts are none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import language, samples
from lexmill.llm.common import map_texts
from lexmill.plans.stage import cut

# Signs of error pages, script notices and filler text.
SIGNS = (
    "lorem", "ipsum", "javascript", "placeholder text", "dummy copy", "sample paragraph", "platzhalter", "mustertext", "blindtext",
    "error 4", "error 5", "http 4", "http 5", "erreur 4", "erreur 5", "fehler 4", "fehler 5", "fout 4", "fout 5", "errore 4", "errore 5",
    "not found", "introuvable", "nicht gefunden", "no se ha encontrado", "non trovata", "niet gevonden", "timed out", "permission denied",
    "access denied", "temporarily unavailable", "no longer available", "enable cookies", "active scripting", "session has expired",
)
SIGN_RE = re.compile("(?i)" + "|".join(map(re.escape, SIGNS)))
_NAME = r"[A-Za-z][\w .'-]{0,40}"
SLOT = re.compile(
    rf"\{{\{{ ?{_NAME}\}}\}}|[$#]\{{ ?{_NAME}\}}|\{{% ?{_NAME}%\}}|<%=? ?{_NAME}%>|\[\[ ?{_NAME}\]\]|@@[\w.]{{1,40}}@@|__[A-Za-z]\w*?__|%%?[A-Za-z][\w.]{{1,40}}%%?(?![0-9A-F])"
    rf"|(?<!\w)\{{\d\}}(?!\w)|\$[A-Za-z_][\w.]{{1,40}}\$|#[A-Za-z_]\w{{1,40}}#|&lt;[A-Za-z_]{{2,40}}&gt;|<[a-z]+_[a-z_]+>|\{{[A-Za-z_][\w.]{{1,40}}\}}|\[[A-Za-z][\w .'-]{{1,60}}\]|\bX{{3,}}(?: ?\([^)\n]{{1,40}}\))?|:\w{{2,40}}: (?:undefined|null)\b|\b(?:undefined|NaN)\b"
)
#: What every slot holds one of; most texts hold none. Several times faster than an expression.
HINTS = (*"{}[]@%$#<>", "__", "XXX", "&lt;", "undefined", "NaN")
TRUSTED = ("{{a}}", "${a}", "<%a%>", "{9}", "[your]", "[insert]", "[object]")
#: Words that belong to a mark's form, not to the name in it.
FORM_WORDS = ("lt", "gt", "undefined", "null", "xxxx", "to", "follow", "block")
QUOTES = "\"'`“”„«»‘’‹›"

SAMPLE, ROUNDS, COMMON, TRUST, PRIOR = 1500, 8, 200, 0.25, 0.03
#: Probability that a passage of a residue record, and of another one, is residue.
INSIDE, OUTSIDE = 0.9, 0.003
HEX = re.compile(r"[a-f]{2,}")
TOKEN = re.compile(r"[^\W_]+|[.!?…:](?=\s+[^\W\d_])|\n")
SPLIT = re.compile(r"(?<=[.!?…:])\s+(?=[^\W\d_])|\n")
SHARE = 0.5


def units(text: str) -> list[list[str]]:
    """Passages as words; numbers are '#', tokens of letters and digits mixed '##'."""
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text.lower()):
        if t[0].isalnum():
            out[-1].append(plain(t))
        elif out[-1]:
            out.append([])
    return [u for u in out if u]


def plain(word: str) -> str:
    if word.isalpha():
        return "##" if HEX.fullmatch(word) else word
    return "#" if word.isdigit() else "##"


def slots(text: str) -> list[tuple[str, ...]]:
    """Features of the text's slots outside quotes; the first one is the shape."""
    out = []
    if not any(h in text for h in HINTS):
        return out
    for m in SLOT.finditer(text):
        a, b = m.span()
        s = m.group(0)
        shape = re.sub(r"[A-Za-z][\w.' -]*", "a", re.sub(r"\d", "9", s.replace("=", ""))).replace(" ", "")
        # A quote mark on both sides.
        quoted = (a > 0 and text[a - 1] in QUOTES) and (b < len(text) and text[b] in QUOTES)
        left = re.findall(r"[^\W_]+", text[max(0, a - 40) : a].lower())[-1:]
        right = re.findall(r"[^\W_]+", text[b : b + 40].lower())[:1]
        inner = [w for w in re.findall(r"[A-Za-z]+", s.replace("_", " ").lower()) if w not in FORM_WORDS]
        if not quoted:  # in quotes it is talked about and stands for no value
            out.append((shape if shape != "[a]" else f"[{inner[0] if inner else ''}]", *(f"in:{w}" for w in inner), *(f"l:{w}" for w in left), *(f"r:{w}" for w in right)))
    return out


class Bayes:
    """Naive Bayes over feature counts: log odds of each feature, and a prior."""

    def __init__(self, odds: dict[str, float], prior: float):
        self.odds, self.prior = odds, prior

    def score(self, features) -> float:
        get = self.odds.get
        return self.prior + sum(get(f, 0.0) for f in features)


def mixture(odds: np.ndarray, owner: np.ndarray, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities that passages are residue, and that their n records are: odds are the passages' log likelihood ratios, owner their records."""
    ratio = np.exp(odds.clip(-30, 30))
    inside, outside = (a * ratio / (a * ratio + 1 - a) for a in (INSIDE, OUTSIDE))
    told = np.log((INSIDE * ratio + 1 - INSIDE) / (OUTSIDE * ratio + 1 - OUTSIDE))
    record = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + np.bincount(owner, told, n)).clip(-30, 30)))
    return record[owner] * inside + (1 - record[owner]) * outside, record


def fit(trusted: list, unlabelled: list, rounds: int = ROUNDS, least: int = 2, mass: float | None = 300.0, alpha: float = 0.5, cap: float = 4.0, skip=frozenset(), prior: float | None = PRIOR, start: float = 0.0, groups: tuple | None = None, owner: np.ndarray | None = None) -> Bayes:
    """Positive-unlabelled naive Bayes by EM; units are lists of features. groups: numbers of the trusted and of the other units' groups, whose mix is made equal in both classes. owner: records of the other units, which then are decided together."""
    seen = Counter(f for u in trusted + unlabelled for f in set(u))
    vocab = [f for f, n in seen.items() if n >= least and f not in skip]
    at = {f: k for k, f in enumerate(vocab)}
    v = len(vocab)

    def matrix(us):
        ids = [[at[f] for f in u if f in at] for u in us]
        lens = np.array([len(x) for x in ids], np.int64)
        return np.array([k for x in ids for k in x], np.int64), np.repeat(np.arange(len(us)), lens)

    pf, _ = matrix(trusted)
    uf, uo = matrix(unlabelled)
    fixed = np.bincount(pf, minlength=v).astype(float)
    n_u = len(unlabelled)
    gt, gu = (np.array(g, np.int64) for g in groups or ([0] * len(trusted), [0] * n_u))
    n_g = int(max(gt.max(initial=0), gu.max(initial=0))) + 1
    size_t, size_u = (np.array([len(u) for u in us], float) for us in (trusted, unlabelled))
    p = np.full(n_u, start)
    odds, fixed_prior = np.zeros(v), prior
    prior = float(np.log((prior or 0.5) / (1 - (prior or 0.5))))
    for _ in range(rounds):
        pos = fixed + np.bincount(uf, weights=p[uo], minlength=v)
        in_pos = np.bincount(gt, size_t, n_g) + np.bincount(gu, size_u * p, n_g)
        in_neg = np.bincount(gu, size_u * (1 - p), n_g)
        even = ((in_pos + 1) / (in_pos.sum() + n_g) / ((in_neg + 1) / (in_neg.sum() + n_g))).clip(0.05, 20)
        neg = np.bincount(uf, weights=((1 - p) * even[gu])[uo], minlength=v)
        if mass is None:
            extra, whole = alpha, alpha * v
        else:  # smoothed towards the mean of both classes, so that what residue lacks never speaks for it
            extra, whole = mass * np.maximum((pos / max(pos.sum(), 1e-9) + neg / max(neg.sum(), 1e-9)) / 2, 1e-9), mass
        odds = np.log((pos + extra) / (pos.sum() + whole)) - np.log((neg + extra) / (neg.sum() + whole))
        odds = odds.clip(-cap, cap)
        if fixed_prior is None:  # the share of residue among all units
            prior = float(np.log((len(trusted) + p.sum() + 1) / (n_u - p.sum() + 1)))
        s = np.bincount(uo, weights=odds[uf], minlength=n_u)
        p = 1 / (1 + np.exp(-(prior + s).clip(-30, 30))) if owner is None else mixture(s, owner, int(owner.max(initial=-1)) + 1, PRIOR)[0]
    return Bayes({f: float(odds[k]) for f, k in at.items()}, prior)


class Scorer:
    """Both models; scores batches of texts."""

    def __init__(self, passages: Bayes, marks: Bayes, share: float = 0.03):
        """share: of residue records among all."""
        self.passages, self.marks, self.share = passages, marks, share
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, 2))
        self.n = 0

    def __getstate__(self):
        return (self.passages, self.marks, self.share)

    def __setstate__(self, s):
        self.passages, self.marks, self.share = s
        self.reset()

    def index(self, t: str) -> int:
        if t[0].isalnum():
            k = self.n
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            w = plain(t)
            self.rows[k] = (self.passages.odds.get(w, 0.0), 0 if w[0] == "#" else len(t))
            self.n += 1
        else:
            k = -1
        self.at[t] = k
        return k

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text the share of its letters in residue passages."""
        if self.n > 300_000:
            self.reset()
        lists = [TOKEN.findall(t.lower()) for t in texts]
        lens = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        at, look = self.at, self.index
        ids = np.fromiter((at[t] if t in at else look(t) for x in lists for t in x), np.int64, int(lens.sum()))
        return self.decided(ids, np.repeat(np.arange(len(lists)), lens), len(texts))

    def decided(self, ids: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
        """For each text the share of its letters in residue passages; ids are the index() of words, negative where a passage ends, owner their texts."""
        word = ids >= 0
        before = np.concatenate([[False], word[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]])
        first = np.flatnonzero((word & ~before)[word])
        ids, owner = ids[word], owner[word]
        share = np.zeros(n_texts)
        if len(ids):
            sums = np.add.reduceat(self.rows[ids], first, axis=0)
            whose = owner[first]
            told = np.where(sums[:, 1] > 0, sums[:, 0], 0.0)
            bad = mixture(told, whose, n_texts, self.share)[0] > 0.5
            total = np.bincount(whose, sums[:, 1], n_texts)
            share = np.bincount(whose, sums[:, 1] * bad, n_texts) / np.maximum(total, 1)
        return share

    def fit_share(self, texts: list[str], rounds: int = 5) -> None:
        """Set the share of residue records to that of these texts, by expectation-maximization."""
        lists = [[u for u in units(t)] for t in texts]
        odds = np.array([sum(self.passages.odds.get(w, 0.0) for w in u) for us in lists for u in us])
        owner = np.repeat(np.arange(len(texts)), [len(us) for us in lists])
        for _ in range(rounds if len(odds) else 0):
            self.share = float((mixture(odds, owner, len(texts), self.share)[1].sum() + 1) / (len(texts) + 2))

    def slot_scores(self, texts: list[str]) -> np.ndarray:
        """For each text the greatest log odds of a slot, -inf without any."""
        return np.array([max((self.marks.score(s) for s in slots(t)), default=-np.inf) for t in texts])


def marked(text: str, low: str) -> bool:
    return any(h in text for h in HINTS) and SLOT.search(text) is not None


#: What samples.Drawn is to draw for train().
KINDS = {"signed": lambda text, low: any(s in low for s in SIGNS), "marked": marked, "plain": lambda text, low: True}


def train(drawn: samples.Drawn, labeller: language.Labeller) -> Scorer:
    """Scorer from texts drawn by KINDS; labeller tells languages."""
    signed, marks, plain_ = (drawn.texts(k) for k in KINDS)
    trusted, rest, owner, common = [], [], [], Counter()
    for k, t in enumerate(dict.fromkeys(signed + plain_)):
        parts = [(bool(SIGN_RE.search(p)), [w for u in units(p) for w in u], p) for p in SPLIT.split(t)]
        letters = [sum(len(w) for w in us if w[0] != "#") for _, us, _ in parts]
        sure_ = sum(n for (sign, _, _), n in zip(parts, letters) if sign) > TRUST * sum(letters)
        (trusted if sure_ else rest).extend((us, p) for _, us, p in parts if us)
        if not sure_:
            owner += [k] * sum(bool(us) for _, us, _ in parts)
            common.update(w for _, us, _ in parts for w in us)

    def langs(us):
        return [max(((n, c) for c, _, n, _ in ss), default=(0, 0))[1] for ss in labeller.label([p for _, p in us])]

    sure, open_ = [], []
    for t in dict.fromkeys(marks + plain_):
        for s in slots(t):
            (sure if s[0] in TRUSTED else open_).append(s)
    skip = frozenset(w for w, _ in common.most_common(min(COMMON, len(common) // 20)))
    groups = (langs(trusted), langs(rest))
    passages = fit([u for u, _ in trusted], [u for u, _ in rest], skip=skip, groups=groups, owner=np.unique(owner, return_inverse=True)[1].astype(np.int64))
    scorer = Scorer(passages, fit(sure, open_, mass=None, prior=None, start=0.9))
    scorer.fit_share(plain_)
    return scorer


def scored(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, residue_share, slot_score, residue) for each record with a text; slot_score is null without slots. labels: delivered language labels."""
    ids = cut(language.sample_ids(labels))
    drawn = samples.Drawn(records, {r.row_id for r in ids.collect()}, KINDS, SAMPLE)
    shared = records.sparkSession.sparkContext.broadcast(train(drawn, language.Labeller(language.train_on(drawn.records(), ids))))

    def make():
        sc = shared.value

        def f(ids, texts):
            share, slot = sc.shares(texts), sc.slot_scores(texts)
            return {
                "row_id": ids,
                "residue_share": share,
                "slot_score": [None if np.isinf(s) else float(s) for s in slot],
                "residue": (share > SHARE) | (slot > 0),
            }

        return f

    return map_texts(records, "row_id bigint, residue_share double, slot_score double, residue boolean", make, "row_id", "text")


def found(records: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id of the records to exclude."""
    return scored(records, labels).where("residue").select("row_id").distinct()


def clean(records: DataFrame, labels: DataFrame) -> DataFrame:
    """The records without residue, null texts kept out; (row_id, n_chars)."""
    bad = scored(records, labels).where("residue").select("row_id").distinct()
    return records.where(F.col("text").isNotNull()).select("row_id", F.length("text").alias("n_chars")).join(bad, "row_id", "left_anti")
