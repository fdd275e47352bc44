"""Text functions against plain Python, on dirty strings."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.python import nfc, unescape

ODD = [None, "", "   \n\t ", "hi there", "a b c", "x" * 50, "<p>Hi &amp; bye</p>", "<!-- a\nb -->t", "Source: x\nbody\n\n\nend", "{}[]<>=\\_", "…a...b....c", "é́ ÀB ﻿\x07", "😀 emoji 😀", "SELECT a\nDROP b"]


def values(spark, column, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r[1] for r in df.select("k", column(T.text(F.col("text")))).orderBy("k").collect()]


def py_repeats(t, n=10):
    w = t.split()
    return max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values(), default=0)


CASES = {
    "words": (T.words, lambda t: t.split()),
    "lines": (T.lines, lambda t: [x.strip() for x in t.splitlines() if x.strip()]),
    "strip": (T.strip, str.strip),
    "symbols": (T.symbol_ratio, lambda t: sum(c in C.CODE_SYMBOLS for c in t) / len(t) if t else 0.0),
    "longest": (T.longest_word, lambda t: max(map(len, t.split()), default=0)),
    "keywords": (T.keyword_count, lambda t: len(set(t.lower().split()) & set(C.CODE_KEYWORDS))),
    "repeats": (T.max_ngram_repeats, py_repeats),
    "ellipsis": (lambda c: T.count(c, T.ELLIPSIS), lambda t: len(re.findall(r"\.{3}|…", t))),
    "density": (T.html_density, lambda t: sum(map(len, re.findall(r"</?[a-zA-Z][^>]*>", t))) / len(t) if t else 0.0),
    "grams": (lambda c: F.size(T.char_grams(c)), lambda t: len({t.lower().strip()[i : i + 13] for i in range(len(t.lower().strip()) - 12)})),
    "ttr": (T.type_token_ratio, lambda t: len(set(w := re.findall("[a-zA-Z]+", t.lower())[:200])) / max(len(w), 1)),
}


@pytest.mark.parametrize("name", CASES)
def test_against_python(spark, name):
    column, plain = CASES[name]
    texts = [*ODD, " ".join(["one two three four five six seven eight nine ten"] * 5), "word " * 30]
    got = values(spark, column, texts)
    assert got == [pytest.approx(plain(t or "")) if isinstance(plain(t or ""), float) else plain(t or "") for t in texts]


def test_random_words(spark):
    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60), min_size=20, max_size=20))
    def run(texts):
        assert values(spark, T.words, texts) == [t.split() for t in texts]
        assert values(spark, T.lines, texts) == [[x.strip() for x in t.splitlines() if x.strip()] for t in texts]

    run()


def test_boilerplate_and_normal(spark):
    t = "Title: A\n*** START OF this\n Body  Text \nURL: x\n<<< End of text >>>\nMore"
    assert values(spark, T.strip_boilerplate, [t]) == ["Body  Text\nMore"]
    assert values(spark, T.normalize, [t]) == ["body text more"]
    assert values(spark, lambda c: T.normalize(nfc(c)), ["Éa"]) == ["éa"]


def test_html(spark):
    assert values(spark, T.strip_html, ["<b>x</b> &lt;i&gt; &amp;amp;", "plain"]) == [" x  <i> &amp;", "plain"]
    assert values(spark, unescape, ["&eacute;&nbsp;", "a"]) == ["é ", "a"]
    assert values(spark, T.html_density, ["<div>Hello</div>"])[0] > 0.5


def test_code(spark):
    code = "```\nx\n```"
    lines = "\n".join(["def f(x): {", "  return x;", "}", "// c", "#include <a>"])
    prose = "We saw the public garden. It was let to a friend.\nNothing else happened that day."
    assert values(spark, T.looks_like_code, [code, lines, prose, "", "<CODE>x"]) == [True, True, False, False, True]


def test_long_text(spark):
    t = "abc def " * 60_000
    assert values(spark, T.longest_word, [t]) == [3]
    assert values(spark, T.max_ngram_repeats, [t])[0] > 50_000
