"""Text as Spark columns, JVM-side but for HTML entities in texts that have some. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions.python import unescape

#: White space as Python's str.split sees it, as the inside of a character class that Java and RE2 both read.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters one by one.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TAG = r"</?[a-zA-Z][^>]*>"
URL, ANY_URL = r"https?://[^" + SPACE + "]+", r"https?://[^" + SPACE + r"]+|www\.[^" + SPACE + "]+"
ELLIPSIS = r"\.{3}|\x{2026}"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, f) -> Column:
    """f(c) with c computed once a row, however often f uses it (inside a lambda Spark would compute it anew for each element)."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda s: s != "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars_in(c: Column, chars: str) -> Column:
    """Number of characters that are one of chars."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def share(n: Column, of: Column) -> Column:
    """n / of, 0 where of is 0."""
    return F.when(of == 0, F.lit(0.0)).otherwise(n / of)


def is_boilerplate(line: Column) -> Column:
    low = F.lower(line)
    hit = low.isin(*C.BOILERPLATE_EXACT)
    for p in C.BOILERPLATE_PREFIXES:
        hit = hit | low.startswith(p)
    return hit


def strip_boilerplate(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda s: ~is_boilerplate(s)), "\n")


def strip_html(c: Column) -> Column:
    """Comments and tags become a blank, then all entities are read."""
    tags = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return unescape(F.when(c.contains("<"), tags).otherwise(c), c.contains("&"))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), C.CONTROL, "")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalize(c: Column) -> Column:
    """Lower case, no boilerplate lines, single blanks. The text should be in NFC (functions.nfc)."""
    return strip(F.regexp_replace(strip_boilerplate(F.lower(c)), f"[{SPACE}]+", " "))


def code_line(s: Column) -> Column:
    return (
        s.rlike(C.COMMENT_LINE)
        | (s.rlike(C.CODE_WORD) & s.rlike(r"[{}();\[\]<>]"))
        | s.rlike(C.BRACKET_LINE)
        | F.upper(F.substring(s, 1, 16)).rlike(C.QUERY_LINE)
        | (chars_in(s, "{}();<>/=+-") / F.greatest(F.length(s), F.lit(1)) > 0.35)
    )


def looks_like_code(c: Column) -> Column:
    sizes = let(lines(c), lambda rows: F.struct(F.size(rows).alias("n"), F.size(F.filter(rows, code_line)).alias("k")))
    return c.rlike(C.FENCE) | let(sizes, lambda s: (s["n"] > 0) & ((s["k"] / F.greatest(s["n"], F.lit(1)) > 0.3) | (s["k"] >= 5)))


def sanitize(c: Column) -> Column:
    return strip(collapse_newlines(strip_boilerplate(strip_urls(strip_control(strip_html(c))))))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def html_density(c: Column) -> Column:
    return share(F.length(c) - F.length(F.regexp_replace(c, TAG, "")), F.length(c))


def symbol_ratio(c: Column) -> Column:
    return share(chars_in(c, C.CODE_SYMBOLS), F.length(c))


def keyword_count(c: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(words(F.lower(c))), F.array(*map(F.lit, C.CODE_KEYWORDS))))


def longest(w: Column) -> Column:
    """Length of the longest of the words w."""
    return F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0))


def longest_word(c: Column) -> Column:
    return longest(words(c))


def repeats(w: Column, n: int = C.REPEAT_WORDS) -> Column:
    """How often the most frequent run of n of the words w occurs; within the row, so without a shuffle."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x.eqNullSafe(a["last"]), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    # Most texts repeat none; only those with a repeated hash are sorted and folded.
    most = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(1)).otherwise(F.aggregate(F.array_sort(h), start, step, lambda a: a["best"])))
    return F.when(F.size(w) < n, F.lit(0)).otherwise(most)


def max_ngram_repeats(c: Column, n: int = C.REPEAT_WORDS) -> Column:
    return let(words(c), lambda w: repeats(w, n))


def char_grams(c: Column, n: int = C.OVERLAP_CHARS) -> Column:
    """Hashes of the distinct runs of n characters of the lower-cased, stripped text. By an array of characters: substring would walk the text from its start each time."""

    def grams(a: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.xxhash64(F.slice(a, i, n)))
        return F.when(F.size(a) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return let(F.regexp_extract_all(strip(F.lower(c)), F.lit("(?s)."), F.lit(0)), grams)


def type_token_ratio(c: Column, first: int = 200) -> Column:
    return let(F.slice(F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+"), F.lit(0)), 1, first), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))


def mean_line_length(c: Column) -> Column:
    rows = F.filter(F.split(c, "\n"), lambda s: strip(s) != "")
    return F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(F.aggregate(F.transform(rows, F.length), F.lit(0), lambda a, x: a + x) / F.size(rows))


def tags(c: Column) -> Column:
    """Artifact tags in fixed order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(t)) for t, p in C.ARTIFACTS)))


def boilerplate_tag(line: Column) -> Column:
    """'exact', the first matching prefix, or null."""
    low = F.lower(line)
    out = F.when(low.isin(*C.BOILERPLATE_EXACT), "exact")
    for p in C.BOILERPLATE_PREFIXES:
        out = out.when(low.startswith(p), p)
    return out
