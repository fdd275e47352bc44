"""Queries over the test tables for every operator of the core, each with the SQL that DuckDB is to agree with where SQL can say it."""

from __future__ import annotations

import html
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import config as C
from lexmill.functions import text as T
from lexmill.functions.labels import NAMES, UNKNOWN
from lexmill.functions.python import nfc
from lexmill.operators import classify, decontaminate, dedup, lm, packing, runs, sampling, signals, status, training, trials
from lexmill.plans import pipeline
from lexmill.plans.stage import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "openwebtext_10k") else df


def add(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# ---- SQL of the text functions, written for DuckDB -------------------------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = f"[{T.SPACE}]"
TXT = "coalesce(text, '')"


def s_strip(x):
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def s_words(x):
    return f"list_filter(string_split_regex({x}, {q(f'{WS}+')}), lambda w: w <> '')"


def s_lines(x):
    return f"list_filter(list_transform(string_split_regex({x}, {q(T.LINE_END)}), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_count(x, p):
    return f"len(regexp_extract_all({x}, {q(p)}))"


def s_chars(x, chars):
    return f"(length({x}) - length(translate({x}, {q(chars)}, '')))"


def s_share(n, of):
    return f"(case when {of} = 0 then 0.0 else {n} / {of} end)"


def s_prefix(low):
    return " or ".join([f"{low} in ({', '.join(map(q, C.BOILERPLATE_EXACT))})", *(f"starts_with({low}, {q(p)})" for p in C.BOILERPLATE_PREFIXES)])


def s_boiler(x):
    return f"array_to_string(list_filter({s_lines(x)}, lambda s: not ({s_prefix('lower(s)')})), chr(10))"


def s_list(values):
    return "[" + ", ".join(map(q, values)) + "]"


#: Every named entity of HTML 5, those that need no semicolon, and what the numbers stand for that are no characters.
_NAMED = sorted(html5.items())
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_ODD = sorted((n, html.unescape(f"&#{n};")) for n in [*range(32), *range(127, 160)] if html.unescape(f"&#{n};") != chr(n))
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def s_unescape(x):
    digits = "case when e[3:3] in ('x', 'X') then try_cast('0x' || regexp_extract(e, '[xX]([0-9a-fA-F]+)', 1) as bigint) else try_cast(regexp_extract(e, '[0-9]+') as bigint) end"
    odd = f"{s_list([c for _, c in _ODD])}[list_position([{', '.join(str(n) for n, _ in _ODD)}], n)]"
    none = "(n between 64976 and 65007 or (n >= 65534 and n % 65536 in (65534, 65535)) or n = 11)"
    number = f"list_transform([{digits}], lambda n: coalesce({odd}, case when n is null or n between 55296 and 57343 or n > 1114111 then chr(65533) when {none} then '' else chr(n::int) end))[1]"
    bare = f"list_filter({s_list(_BARE)}, lambda k: starts_with(e[2:], k))[1]"
    values, keys = s_list([v for _, v in _NAMED]), s_list([k for k, _ in _NAMED])
    name = f"coalesce({values}[list_position({keys}, e[2:])], list_transform([{bare}], lambda k: {values}[list_position({keys}, k)] || e[2 + length(k):])[1], e)"
    one = f"list_transform([es[i]], lambda e: case when e is null then '' when e[2:2] = '#' then {number} else {name} end)[1]"
    return (
        f"list_transform([{x}], lambda t: case when contains(t, '&') then list_transform([regexp_extract_all(t, {q(_ENTITY)})], lambda es: list_transform([string_split_regex(t, {q(_ENTITY)})],"
        f" lambda ps: array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || {one}), ''))[1])[1] else t end)[1]"
    )


def s_html(x):
    tags = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return s_unescape(f"(case when contains({x}, '<') then {tags} else {x} end)")


def s_control(x):
    return f"regexp_replace(replace({x}, chr(9), ' '), {q(C.CONTROL)}, '', 'g')"


def s_urls(x):
    return f"regexp_replace({x}, {q(T.URL)}, '', 'g')"


def s_newlines(x):
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def s_normal(x):
    return s_strip(f"regexp_replace({s_boiler(f'lower({x})')}, {q(f'{WS}+')}, ' ', 'g')")


def s_sanitize(x):
    return s_strip(s_newlines(s_boiler(s_urls(s_control(s_html(x))))))


def s_code(x):
    line = (
        f"(regexp_matches(s, {q(C.COMMENT_LINE)}) or (regexp_matches(s, {q(C.CODE_WORD)}) and regexp_matches(s, '[{{}}();\\[\\]<>]')) or regexp_matches(s, {q(C.BRACKET_LINE)})"
        f" or regexp_matches(upper(s[1:16]), {q(C.QUERY_LINE)}) or {s_chars('s', '{}();<>/=+-')} / greatest(length(s), 1) > 0.35)"
    )
    n, k = f"len({s_lines(x)})", f"len(list_filter({s_lines(x)}, lambda s: {line}))"
    return f"(regexp_matches({x}, {q(C.FENCE)}) or ({n} > 0 and ({k} / greatest({n}, 1) > 0.3 or {k} >= 5)))"


def s_density(x):
    return s_share(f"(length({x}) - length(regexp_replace({x}, {q(T.TAG)}, '', 'g')))", f"length({x})")


def s_symbols(x):
    return s_share(s_chars(x, C.CODE_SYMBOLS), f"length({x})")


def s_keywords(x):
    return f"len(list_filter(list_distinct({s_words(f'lower({x})')}), lambda w: w in ({', '.join(map(q, C.CODE_KEYWORDS))})))"


def s_longest(x):
    return f"coalesce(list_max(list_transform({s_words(x)}, lambda w: length(w))), 0)"


def s_repeats(source, x, n=C.REPEAT_WORDS):
    """Table (doc_id, r) of source."""
    return (
        f"(select doc_id, coalesce(max(k), 0) r from (select d.doc_id, g, count(*) k from (select doc_id, {s_words(x)} w from {source}) d"
        f" left join lateral (select array_to_string(d.w[i:i+{n - 1}], ' ') g from range(1, len(d.w) - {n - 2}) t(i)) on true where g is not null group by 1, 2) group by 1)"
    )


def s_ellipsis(x):
    n = s_count(x, T.ELLIPSIS)
    return f"(case when {n} > 0 and {n} / greatest(len({s_words(x)}), 1) > {C.MAX_ELLIPSIS} then 'excessive_ellipsis' else 'kept' end)"


def s_code_status(x):
    return (
        f"(case when contains({x}, '```') then 'code_fence' when {s_density(x)} > {C.MAX_HTML} then 'html_density' when {s_symbols(x)} > {C.MAX_SYMBOLS} then 'symbol_ratio'"
        f" when {s_keywords(x)} > {C.MAX_KEYWORDS} then 'keyword_density' else 'kept' end)"
    )


def s_quality(x, r):
    return (
        f"(case when len({s_words(x)}) < {C.MIN_WORDS} then 'too_few_words' when length({x}) < {C.MIN_CHARS} then 'too_few_chars' when {s_longest(x)} > {C.MAX_WORD} then 'unnatural_word'"
        f" when coalesce({r}, 0) > {C.MAX_REPEATS} then 'ngram_repetition' else 'kept' end)"
    )


def s_label(x):
    """Delivered label x as a key of NAMES, another code, or null; see functions.labels."""
    low = f"regexp_replace(lower(trim({x})), '^__label__', '')"
    code = f"(case when {low} in ({', '.join(map(q, UNKNOWN))}) then null else regexp_replace({low}, '[-_].*$', '') end)"
    whens = " ".join(f"when {code} in ({', '.join(map(q, names))}) then {q(c)}" for c, names in NAMES.items())
    return f"(case {whens} else {code} end)"


def s_clean_status(x):
    return f"(case when {x} = '' then 'empty_after_clean' when {s_code(x)} then 'code_snippet' else 'kept' end)"


# ---- scalars of documents ---------------------------------------------------------------------------------------------
def scalar(name: str, column, sql: str, source: str = "documents", key: str = "doc_id"):
    alias = name

    @add(name, f"select {key}, {sql} as {alias} from {source}")
    def run(spark, d):
        return table(spark, d, source).select(key, column(T.text(F.col("text"))).alias(alias))


WEB = {"source": "openwebtext_10k", "key": "row_id"}
long = lambda f: lambda c: f(c).cast("bigint")
r6 = lambda f: lambda c: F.round(f(c), 6)

scalar("normalize_text", lambda c: T.normalize(nfc(c)), s_normal(f"nfc_normalize({TXT})"))
scalar("strip_boilerplate", T.strip_boilerplate, s_boiler(TXT))
scalar("strip_html", T.strip_html, s_html(TXT), **WEB)
scalar("strip_control", T.strip_control, s_control(TXT), **WEB)
scalar("had_control", lambda c: T.strip_control(c) != F.replace(c, F.lit("\t"), F.lit(" ")), f"({s_control(TXT)} <> replace({TXT}, chr(9), ' '))", **WEB)
scalar("strip_urls", T.strip_urls, s_urls(TXT), **WEB)
scalar("collapse_newlines", T.collapse_newlines, s_newlines(TXT), **WEB)
scalar("looks_like_code", T.looks_like_code, s_code(TXT))
scalar("first_line", T.first_line, s_strip(f"string_split({TXT}, chr(10))[1]"))
scalar("text_prefix", lambda c: F.substring(c, 1, 256), f"{TXT}[1:256]")
scalar("has_code_fence", lambda c: c.contains("```"), f"contains({TXT}, '```')")
scalar("html_density", r6(T.html_density), f"round({s_density(TXT)}, 6)", **WEB)
scalar("symbol_ratio", r6(T.symbol_ratio), f"round({s_symbols(TXT)}, 6)")
scalar("keyword_count", long(T.keyword_count), s_keywords(TXT))
scalar("longest_word", long(T.longest_word), s_longest(TXT))
scalar("ellipsis_count", long(lambda c: T.count(c, T.ELLIPSIS)), s_count(TXT, T.ELLIPSIS))
scalar("word_count", long(lambda c: F.size(T.words(c))), f"len({s_words(TXT)})")
scalar("char_count", long(F.length), f"length({TXT})")
scalar("code_status", status.code_status, s_code_status(TXT), **WEB)
scalar("ellipsis_status", status.ellipsis_status, s_ellipsis(TXT), **WEB)
_LABEL = "coalesce(lower(lang), 'unknown')"


@add("label_training_line", f"select doc_id, '__label__' || {_LABEL} || ' ' || {s_strip(f'string_split({TXT}, chr(10))[1]')} line from documents where {s_strip(f'string_split({TXT}, chr(10))[1]')} <> ''")
def _(spark, d):
    return classify.labelled_lines(table(spark, d, "documents"), F.coalesce(F.lower("lang"), F.lit("unknown")), "doc_id")


@add("lm_training_lines", f"select doc_id, line from (select doc_id, {s_strip(f'replace({TXT}, chr(10), chr(32))')} line from documents) where line <> '' order by doc_id limit 300")
def _(spark, d):
    return lm.training_lines(table(spark, d, "documents"), 300)


scalar("lm_training_line", lambda c: T.strip(F.replace(c, F.lit("\n"), F.lit(" "))), s_strip(f"replace({TXT}, chr(10), ' ')"))
scalar("html_unescape_density", r6(lambda c: T.html_density(T.strip_html(c))), f"round({s_density(s_html(TXT))}, 6)", **WEB)


@add("max_ngram_repeats", f"select d.doc_id, coalesce(r, 0) max_ngram_repeats from documents d left join {s_repeats('documents', TXT)} x using (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.max_ngram_repeats(T.text(F.col("text"))).cast("bigint").alias("max_ngram_repeats"))


@add("quality_status", f"select status, count(*) n from (select {s_quality(TXT, 'r')} status from documents d left join {s_repeats('documents', TXT)} x using (doc_id)) group by 1")
def quality_counts(spark, d):
    return table(spark, d, "documents").groupBy(status.quality_status(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


@add("sanitize", f"select doc_id, case when status = 'kept' then c else '' end clean_text, status from (select doc_id, c, {s_clean_status('c')} status from (select doc_id, {s_sanitize(TXT)} c from documents))")
def _(spark, d):
    return status.sanitized(table(spark, d, "documents"))


_VERDICT = f"""with c as materialized (select doc_id, lang, {s_sanitize(TXT)} c from documents), s as materialized (select doc_id, {s_clean_status('c')} s1,
 case when {s_label('lang')} = 'en' then 'kept' else 'other_language' end s2, {s_code_status('c')} s3, {s_quality('c', 'r')} s4, {s_ellipsis('c')} s5
 from c left join {s_repeats('c', 'c')} x using (doc_id)),
v as (select doc_id, case when s1 <> 'kept' then 'sanitize' when s2 <> 'kept' then 'language' when s3 <> 'kept' then 'code' when s4 <> 'kept' then 'quality' when s5 <> 'kept' then 'ellipsis' else 'kept' end phase,
 case when s1 <> 'kept' then s1 when s2 <> 'kept' then s2 when s3 <> 'kept' then s3 when s4 <> 'kept' then s4 else s5 end reason from s)"""


@add("pipeline_verdicts", _VERDICT + " select doc_id, phase, reason from v")
def _(spark, d):
    return status.verdicts(table(spark, d, "documents"))


@add(
    "row_phase_funnel",
    _VERDICT + ", p as (select * from (values (0, 'input'), (1, 'sanitize'), (2, 'language'), (3, 'code'), (4, 'quality'), (5, 'ellipsis')) t(step, phase))"
    " select p.step, p.phase, false skipped, cast((select count(*) from v) - (select count(*) from v join p o on v.phase = o.phase where o.step <= p.step) as bigint) n_left from p",
)
def _(spark, d):
    return status.funnel(table(spark, d, "documents"))


@add("status_tally", _VERDICT + " select reason, count(*) n from v group by 1")
def _(spark, d):
    return status.verdicts(table(spark, d, "documents")).groupBy("reason").agg(F.count("*").alias("n"))


@add(
    "language_confidence_filter",
    "with l as (select *, row_number() over (partition by row_id order by detected_at desc nulls last, lang_conf desc nulls last, lang desc nulls last) k from detect_language_batch)"
    f" select row_id, {s_label('lang')} lang, round(case when lang_conf > 1 then lang_conf / 100 else lang_conf end, 6) conf from l where k = 1 and {s_label('lang')} = 'en' and round(case when lang_conf > 1 then lang_conf / 100 else lang_conf end, 6) >= 0.8",
)
def _(spark, d):
    return classify.labelled_language(table(spark, d, "detect_language_batch"))


@add("code_classifier")
def _(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select(F.explode(T.lines(T.text(F.col("text")))).alias("text"))
    labelled = lines.select("text", T.code_line(F.col("text")).cast("int").alias("label"))
    labelled = labelled.union(spark.createDataFrame([("$ make install", 1), ("The book is here.", 0)], "text string, label int"))
    return classify.code_filter(docs, classify.train(labelled, 10))


# ---- decontamination and deduplication --------------------------------------------------------------------------------
def s_fp(key, source):
    n = s_normal(f"nfc_normalize({TXT})")
    return f"(select {key}, case when n = '' then null else sha1(n) end fp from (select {key}, {n} n from {source}))"


@add("fingerprint", f"select doc_id, fp from {s_fp('doc_id', 'documents')}")
def _(spark, d):
    return decontaminate.fingerprints(table(spark, d, "documents"))


@add("decontaminate_hash", f"select doc_id, fp, case when fp is null then 'empty_after_normalize' when fp in (select fp from {s_fp('item_id', 'benchmark')} where fp is not null) then 'test_overlap' else 'kept' end status from {s_fp('doc_id', 'documents')}")
def _(spark, d):
    return decontaminate.status(table(spark, d, "documents"), table(spark, d, "benchmark"))


def s_grams(key, source):
    return f"(select distinct {key}, t[i:i+12] g from (select {key}, {s_strip(f'lower({TXT})')} t from {source}) x, lateral (select unnest(range(1, length(x.t) - 11)) i))"


@add(
    "decontaminate_chars",
    f"with g as (select * from {s_grams('doc_id', 'documents')}), b as (select distinct g from {s_grams('item_id', 'benchmark')}),"
    " k as (select g.doc_id, count(*) n, count(b.g) m from g left join b on g.g = b.g group by 1)"
    f" select d.doc_id, coalesce(n, 0) n_grams, coalesce(m, 0) n_matched, round(coalesce(m / n, 0.0), 6) ratio, coalesce(m / n, 0.0) > {C.MAX_OVERLAP} contaminated from documents d left join k using (doc_id)",
)
def _(spark, d):
    return decontaminate.char_overlap(table(spark, d, "documents"), table(spark, d, "benchmark"))


@add("benchmark_index_growth", f"select split_name, count(*) n from (select fp, min(split_name) split_name from (select b.split_name, f.fp from benchmark b join {s_fp('item_id', 'benchmark')} f using (item_id) where fp is not null) group by 1) group by 1")
def _(spark, d):
    b = table(spark, d, "benchmark")
    fp = decontaminate.fingerprints(b, "item_id").join(b.select("item_id", "split_name"), "item_id").where("fp is not null")
    return fp.groupBy("fp").agg(F.min("split_name").alias("split_name")).groupBy("split_name").agg(F.count("*").alias("n"))


_COLLAPSED = s_strip(f"regexp_replace(lower(nfc_normalize({TXT})), {q(f'{WS}+')}, ' ', 'g')")


@add("exact_duplicates", f"select fp, count(*) n_docs, min(row_id) first_id from (select row_id, sha1({_COLLAPSED}) fp from openwebtext_10k) group by 1 having count(*) > 1")
def _(spark, d):
    return dedup.exact_clusters(table(spark, d, "openwebtext_10k").withColumnRenamed("row_id", "doc_id"))


_W = s_words(f"lower({TXT})")
_HASHES = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(C.HASHES))
_SIG = f"""with recursive w as materialized (select doc_id, {_W} w from documents),
h as materialized (select distinct doc_id, cast('0x' || md5(array_to_string(w[i:i+{C.SHINGLE - 1}], ' '))[1:7] as bigint) h from w, lateral (select unnest(range(1, len(w.w) - {C.SHINGLE - 2})) i)),
m as materialized (select doc_id, k, min((h * a + b) % {C.PRIME}) v from h, (values {_HASHES}) p(k, a, b) group by 1, 2),
sig as materialized (select d.doc_id, p.k, coalesce(m.v, {C.EMPTY_HASH}) v from documents d cross join (select unnest(range({C.PERMUTATIONS})) k) p left join m on m.doc_id = d.doc_id and m.k = p.k),
bk as materialized (select doc_id, k // 4 band, string_agg(v::varchar, '-' order by k) key from sig group by 1, 2),
e as materialized (select distinct f.a, b.doc_id b from bk b join (select band, key, min(doc_id) a from bk group by 1, 2 having count(*) > 1) f using (band, key) where f.a <> b.doc_id)"""
_CC = _SIG + """, both_ as (select a x, b y from e union select b, a from e), cc as (select x id, x root from both_ union select b.y, cc.root from cc join both_ b on cc.id = b.x where cc.root < b.y),
cl as (select id doc_id, min(root) cluster from cc group by 1)"""


@add("shingle_hashes", _SIG + " select doc_id, count(*) n, sum(h)::bigint total from h group by 1")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(dedup.shingle_hashes(F.col("text"))).alias("h"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@add("minhash_signature", _SIG + " select doc_id, string_agg(v::varchar, ',' order by k) sig from sig group by 1")
def _(spark, d):
    return dedup.signatures(table(spark, d, "documents")).select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@add("lsh_buckets", _SIG + " select doc_id, band, key from bk")
def _(spark, d):
    return dedup.buckets(dedup.signatures(table(spark, d, "documents")))


@add("dedup_links", _SIG + " select a, b from e")
def _(spark, d):
    return dedup.links(table(spark, d, "documents"))


@add("dedup_components", _CC + " select doc_id, cluster from cl")
def _(spark, d):
    return dedup.clusters(table(spark, d, "documents"))


@add("dedup_survivors", _CC + " select doc_id from documents where doc_id not in (select doc_id from cl where doc_id <> cluster)")
def _(spark, d):
    return dedup.survivors(table(spark, d, "documents")).select("doc_id")


@add("jaccard_estimate", _SIG + f" select e.a, e.b, case when bool_or(x.v = {C.EMPTY_HASH}) then 0.0 else count(*) filter (x.v = y.v) / {C.PERMUTATIONS} end similarity from e join sig x on x.doc_id = e.a join sig y on y.doc_id = e.b and y.k = x.k group by 1, 2")
def _(spark, d):
    return dedup.estimated_similarity(table(spark, d, "documents"))


# ---- samples ---------------------------------------------------------------------------------------------------------
def s_key(seed, c="doc_id"):
    return f"md5('{seed}-' || {c})"


_TOPICS = C.Config()
_TOPIC = "lower(trim(source))"
_TARGETS = ", ".join(f"({q(k)}, {w / sum(_TOPICS.topic_distribution.values())!r})" for k, w in _TOPICS.topic_distribution.items())


@add(
    "topic_resample",
    f"with t as (select doc_id, {_TOPIC} topic from documents where {_TOPIC} in ({', '.join(map(q, _TOPICS.topic_classes))})), w as (select * from (values {_TARGETS}) x(topic, w)),"
    f" r as (select doc_id, t.topic, w.w, row_number() over (partition by t.topic order by {s_key(_TOPICS.seed)}, doc_id) k from t left join w using (topic))"
    " select doc_id, topic from r where w is null or k <= floor((select count(*) from t) * w)",
)
def _(spark, d):
    return sampling.topic_resample(table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("topic")))


@add("topic_shares", f"select topic, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from (select {_TOPIC} topic from documents where {_TOPIC} in ({', '.join(map(q, _TOPICS.topic_classes))})) group by 1")
def _(spark, d):
    from pyspark.sql.window import Window

    t = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("topic")).where(F.col("topic").isin(*_TOPICS.topic_classes))
    t = t.groupBy("topic").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@add("token_budget_sample", f"select doc_id from documents order by {s_key(7)}, doc_id limit {sampling.docs_for_budget(200_000)}")
def _(spark, d):
    return sampling.budget_sample(table(spark, d, "documents"), 200_000, 7).select("doc_id")


@add("first_n_sample", "select doc_id, source from documents order by doc_id limit 100")
def _(spark, d):
    return sampling.first_rows(table(spark, d, "documents").select("doc_id", "source"), 100)


@add("labelled_sample", f"select doc_id, lang from (select doc_id, lower(lang) lang, row_number() over (partition by lower(lang) order by {s_key(3)}, doc_id) k from documents where lang is not null and {s_strip(f'string_split({TXT}, chr(10))[1]')} <> '') where k <= 20")
def _(spark, d):
    t = table(spark, d, "documents").where(F.col("lang").isNotNull() & (T.first_line(T.text(F.col("text"))) != "")).select("doc_id", F.lower("lang").alias("lang"))
    return sampling.few(t, "lang", 20, 3)


@add("shard_assignment", "select cast(floor((k - 1) / 250) as bigint) shard, count(*) n, min(doc_id) first_id from (select doc_id, row_number() over (order by doc_id) k from documents) group by 1")
def _(spark, d):
    from lexmill.plans.prefix import running_total

    one = table(spark, d, "documents").select("doc_id", F.lit(1).cast("bigint").alias("one"))
    r = running_total(one, "doc_id", "one", "k").withColumn("shard", F.floor(F.col("k") / 250).cast("bigint"))
    return r.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@add("epoch_shuffle", f"select doc_id, {s_key(43)} h from documents order by {s_key(43)}, doc_id offset 64")
def _(spark, d):
    return training.shuffled(table(spark, d, "documents"), 42, 1, 64)


@add("eval_text", "select split_name, string_agg(coalesce(text, ''), chr(10) || chr(10) order by item_id) eval_text from benchmark group by 1")
def _(spark, d):
    b = table(spark, d, "benchmark").groupBy("split_name").agg(F.array_sort(F.collect_list(F.struct("item_id", T.text(F.col("text")).alias("t")))).alias("x"))
    return b.select("split_name", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("eval_text"))


# ---- tokens ----------------------------------------------------------------------------------------------------------
_LEN = f"l as materialized (select doc_id, len({s_words(TXT)}) + 1 n from documents)"


def lengths(spark, d):
    return packing.word_lengths(table(spark, d, "documents"))


@add("token_offsets", f"with {_LEN} select doc_id, n n_tokens, cast(sum(n) over (order by doc_id) - n as bigint) start from l")
def _(spark, d):
    return packing.offsets(lengths(spark, d))


_SPLIT = f"with {_LEN}, t as (select sum(n)::bigint t, least(sum(n), greatest(1, floor(sum(n) * 0.01)))::bigint v from l)"


@add("train_val_split", _SPLIT + " select split, n n_tokens, n // 1025 * 1025 n_kept, n // 1025 n_chunks from (select 'train' split, t - v n from t union all select 'val', v from t)")
def _(spark, d):
    return packing.split(lengths(spark, d))


@add(
    "pack_chunks",
    _SPLIT + ", o as (select doc_id, sum(n) over (order by doc_id) - n s, sum(n) over (order by doc_id) e from l), p as (select 'val' split, 0 lo, v hi from t union all select 'train', v, t from t),"
    " c as (select split, unnest(range((hi - lo) // 1025)) chunk, lo from p) select split, chunk, min(doc_id) first_doc, max(doc_id) last_doc, count(*) n_docs from c join o on o.s < lo + (chunk + 1) * 1025 and o.e > lo + chunk * 1025 group by 1, 2",
)
def _(spark, d):
    return packing.chunks(lengths(spark, d))


@add("eval_windows", _SPLIT + " select w as \"window\", w * 256 start, 256::bigint n_targets from (select unnest(range(least(100, greatest(0, ceil((t - 256) / 256)))::bigint)) w from t)")
def _(spark, d):
    return packing.eval_windows(spark, packing.total_tokens(lengths(spark, d)), 256, 100)


@add("min_tokens_impact", f"with {_LEN} select k min_tokens, count(*) filter (n < k) dropped, count(*) filter (n >= k) kept, round(100 * coalesce(sum(n) filter (n >= k), 0) / sum(n), 6) coverage from l, (select unnest([16, 32, 64, 128, 256, 512, 1024]) k) group by 1")
def _(spark, d):
    return packing.cutoffs(lengths(spark, d))


@add("length_histogram", f"with {_LEN} select case when n <= 32 then '(0,32]' when n <= 64 then '(32,64]' when n <= 128 then '(64,128]' when n <= 256 then '(128,256]' when n <= 512 then '(256,512]' when n <= 1024 then '(512,1024]' else '(1024,inf]' end bin, count(*) n_docs from l group by 1")
def _(spark, d):
    return packing.histogram(lengths(spark, d))


@add("token_percentiles", f"with {_LEN} select p percentile, floor(quantile_cont(n::double, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])[k])::bigint as value from l, (values (1, 1), (5, 2), (10, 3), (25, 4), (50, 5), (75, 6), (90, 7), (95, 8), (99, 9)) x(p, k) group by p, k")
def _(spark, d):
    return signals.percentiles(lengths(spark, d))


@add("token_extrapolation", f"with {_LEN} select floor(avg(n) * {C.FULL_CORPUS_DOCS})::bigint tokens from l")
def _(spark, d):
    return signals.extrapolated_tokens(lengths(spark, d))


@add("bpe_tokenize")
def _(spark, d):
    return packing.tokenize(table(spark, d, "documents")).select("doc_id", "n_tokens")


# The pipeline phase by phase; near-duplicates by comparing all pairs with a shingle in common.
_PIPE = f"""with recursive a0 as materialized (select d.doc_id, d.text, d.lang, {_TOPIC} topic from documents d join {s_fp('doc_id', 'documents')} f using (doc_id)
  where fp is not null and fp not in (select fp from {s_fp('item_id', 'benchmark')} where fp is not null)),
 c1 as materialized (select doc_id, lang, topic, {s_sanitize(TXT)} c from a0), a1 as materialized (select * from c1 where {s_clean_status('c')} = 'kept'),
 a2 as materialized (select * from a1 where {s_label('lang')} = 'en'), t as (select * from a2 where topic in ({', '.join(map(q, _TOPICS.topic_classes))})),
 w as (select * from (values {_TARGETS}) x(topic, w)), r as (select t.*, w.w, row_number() over (partition by t.topic order by {s_key(_TOPICS.seed)}, doc_id) k from t left join w using (topic)),
 a3 as materialized (select doc_id, c from r where w is null or k <= floor((select count(*) from t) * w)), a4 as materialized (select * from a3 where {s_code_status('c')} = 'kept'),
 a5 as materialized (select a4.* from a4 left join {s_repeats('a4', 'c')} x using (doc_id) where {s_quality('c', 'r')} = 'kept'),
 sw as materialized (select doc_id, {s_words('lower(c)')} w from a5),
 sh as materialized (select distinct doc_id, case when len(w) < {C.SHINGLE} then array_to_string(w, ' ') else array_to_string(w[i:i+{C.SHINGLE - 1}], ' ') end g from sw x, lateral (select unnest(range(1, greatest(len(x.w) - {C.SHINGLE - 2}, 2))) i) where len(w) > 0),
 n as materialized (select doc_id, count(*) n from sh group by 1),
 o as materialized (select x.doc_id a, y.doc_id b, count(*) k from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
 e as materialized (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where k / (p.n + q.n - k) >= {C.SIMILAR}),
 both_ as materialized (select a x, b y from e union select b, a from e), cc as (select x id, x root from both_ union select b.y, cc.root from cc join both_ b on cc.id = b.x where cc.root < b.y),
 cl as (select id doc_id, min(root) cluster from cc group by 1), a6 as materialized (select * from a5 where doc_id not in (select doc_id from cl where doc_id <> cluster)),
 a7 as (select * from a6 where {s_ellipsis('c')} = 'kept')"""


def curation(spark, d, topic=True, **config):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.lower(F.trim("source")).alias("topic"))
    return pipeline.Curation(docs, table(spark, d, "benchmark"), C.Config(**config), topic="topic" if topic else None)


@add("curation_pipeline", _PIPE + " select doc_id, length(c)::bigint n_chars from a7")
def _(spark, d):
    return curation(spark, d).kept.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@add("filter_funnel", _PIPE + " " + " union all ".join(f"select {k} step, {q(p)} phase, false skipped, count(*) n_left from {f}" for k, (p, f) in enumerate(zip(("input", *pipeline.PHASES), ("documents", *(f"a{k}" for k in range(8)))))))
def _(spark, d):
    return curation(spark, d).funnel(tokens=False)


# The same over the tokens of the public vocabulary, which SQL doesn't have.
def bpe_lengths(spark, d):
    return cut(packing.tokenize(table(spark, d, "documents")).select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")))


for _name, _of in {
    "token_offsets": packing.offsets, "train_val_split": packing.split, "pack_chunks": packing.chunks, "min_tokens_impact": packing.cutoffs, "length_histogram": packing.histogram,
    "token_percentiles": signals.percentiles, "token_extrapolation": signals.extrapolated_tokens,
}.items():
    QUERIES[f"bpe_{_name}"] = lambda spark, d, of=_of: of(bpe_lengths(spark, d))


@add("funnel_to_tokens")
def _(spark, d):
    return curation(spark, d).funnel()


@add("curated_tokens")
def _(spark, d):
    return curation(spark, d, topic=False).tokens().select("doc_id", "n_tokens")


# ---- signals ---------------------------------------------------------------------------------------------------------
def s_describe(x):
    ps = ", ".join(f"round(quantile_cont(x, {p}), 6) {n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
    return f"select round(avg(x), 6) mean, round(stddev_pop(x), 6) std, round(min(x), 6) min, round(max(x), 6) max, {ps} from (select cast({x} as double) x from documents)"


@add("length_describe", s_describe(f"length({TXT})"))
def _(spark, d):
    return signals.describe(table(spark, d, "documents").select(F.length(T.text(F.col("text"))).alias("n")), "n")


@add("word_describe", s_describe(f"len({s_words(TXT)})"))
def _(spark, d):
    return signals.describe(table(spark, d, "documents").select(F.size(T.words(T.text(F.col("text")))).alias("n")), "n")


_N = f"greatest(len({s_words(TXT)}), 1)"
_LINES = f"list_filter(string_split({TXT}, chr(10)), lambda s: {s_strip('s')} <> '')"
_TTR = f"regexp_extract_all(lower({TXT}), '[a-zA-Z]+')[1:200]"
_DOTS = s_count(TXT, r"\. ")
_SIGNALS = f"""select doc_id, round({s_count(TXT, signals.PUNCTUATION)} / {_N}, 6) punct_per_word,
 round({s_count(TXT, chr(92) + 'p{Lu}')} / greatest({s_count(TXT, chr(92) + 'p{L}')}, 1), 6) upper_ratio,
 round(case when len({_LINES}) = 0 then 0.0 else list_sum(list_transform({_LINES}, lambda s: length(s))) / len({_LINES}) end, 6) mean_line,
 round(len(list_distinct({_TTR})) / greatest(len({_TTR}), 1), 6) ttr, round({s_count(TXT, T.ANY_URL)} / {_N}, 6) url_per_word,
 round({s_count(TXT, chr(92) + 'p{Nd}')} / greatest(length({TXT}), 1), 6) digit_ratio, greatest(1, len(string_split({TXT}, chr(10) || chr(10))) - 1) paragraphs,
 {s_count(TXT, C.HEADING)} headings, round({s_chars(TXT, '"')} / {_N}, 6) quotes_per_word, greatest(1, {_DOTS}) sentences, round({_N} / greatest(1, {_DOTS}), 6) words_per_sentence from documents"""


@add("document_signals", _SIGNALS)
def _(spark, d):
    return signals.signals(table(spark, d, "documents"))


_CORR = " union all ".join(f"select {q(a)} a, {q(b)} b, round(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end, 4) r from s" for i, a in enumerate(signals.SIGNALS) for b in signals.SIGNALS[i + 1 :])


@add("signal_correlation", f"with s as materialized ({_SIGNALS}) {_CORR}")
def _(spark, d):
    return signals.correlations(signals.signals(table(spark, d, "documents")), signals.SIGNALS)


@add("least_varied_documents", f"with s as materialized ({_SIGNALS}) select doc_id, ttr from s order by ttr, doc_id limit 10")
def _(spark, d):
    return signals.worst(signals.signals(table(spark, d, "documents")).select("doc_id", "ttr"), "ttr", 10)


@add("signal_flags", f"with s as materialized ({_SIGNALS}) select 'ttr < 0.6' flag, count(*) filter (ttr < 0.6) n, round(avg((ttr < 0.6)::int), 6) share from s union all select 'urls', count(*) filter (url_per_word > 0.05), round(avg((url_per_word > 0.05)::int), 6) from s")
def _(spark, d):
    return signals.flag_counts(signals.signals(table(spark, d, "documents")), "ttr", {"ttr < 0.6": "ttr < 0.6", "urls": "url_per_word > 0.05"})


@add(
    "char_composition",
    f"select round(100 * d / n, 6) digit, round(100 * p / n, 6) punct, round(100 * s / n, 6) space, round(100 * (n - d - p - s) / n, 6) other from"
    f" (select sum(length({TXT})) + count(*) - 1 n, sum({s_count(TXT, '[0-9]')}) d, sum({s_count(TXT, signals.PUNCTUATION)}) p, sum({s_count(TXT, WS)}) + count(*) - 1 s from documents)",
)
def _(spark, d):
    return signals.composition(table(spark, d, "documents"))


@add("top_words", f"select word, count(*) n from (select unnest(regexp_extract_all(lower({TXT}), {q('[a-zA-Z' + chr(39) + ']+')})) word from documents) where length(word) > 2 and word not in ({', '.join(map(q, C.STOP_WORDS))}) group by 1 order by n desc, word limit 20")
def _(spark, d):
    return signals.top_words(table(spark, d, "documents"))


@add("language_counts", "select coalesce(lower(lang), 'unknown') lang, count(*) n from documents group by 1 order by n desc, 1 limit 10")
def _(spark, d):
    return signals.language_counts(table(spark, d, "documents"))


@add("other_languages", f"select doc_id, coalesce(lower(lang), 'unknown') lang, {TXT}[1:100] preview from documents where coalesce(lower(lang), 'unknown') <> 'en'")
def _(spark, d):
    return signals.other_languages(table(spark, d, "documents"))


@add("language_filter", "select doc_id from documents where lower(lang) = 'en'")
def _(spark, d):
    return table(spark, d, "documents").where(F.lower("lang") == "en").select("doc_id")


_TAGS = (
    f"select doc_id, unnest(list_filter([case when regexp_matches({TXT}, '</?[a-zA-Z][^>]{{0,200}}>') then 'html' end, case when regexp_matches({TXT}, '(?s)```.+?```|<code>|</code>|&lt;code&gt;') then 'code' end,"
    f" case when regexp_matches({TXT}, '(?im)^(title|category|comments?|permalink|posted by|tags):') then 'header' end, case when regexp_matches({TXT}, '(?i)Traceback \\(most recent call last\\)|Exception in thread') then 'stacktrace' end,"
    f" case when regexp_matches({TXT}, '[^\\t\\n\\r\\x20-\\x7e]') then 'non_ascii' end], lambda x: x is not null)) tag from documents"
)


@add("artifact_tags", f"select tag, count(*) n from ({_TAGS}) group by 1")
def _(spark, d):
    return signals.tag_counts(table(spark, d, "documents"))


@add("artifact_examples", f"select tag, doc_id from (select tag, doc_id, row_number() over (partition by tag order by doc_id) k from ({_TAGS})) where k <= 3")
def _(spark, d):
    return signals.tag_examples(table(spark, d, "documents"))


_BTAG = f"case when lower(s) in ({', '.join(map(q, C.BOILERPLATE_EXACT))}) then 'exact' " + " ".join(f"when starts_with(lower(s), {q(p)}) then {q(p)}" for p in C.BOILERPLATE_PREFIXES) + " end"


@add("boilerplate_markers", f"select tag, count(*) n from (select {_BTAG} tag from (select unnest({s_lines(TXT)}) s from documents)) where tag is not null group by 1")
def _(spark, d):
    return signals.boilerplate_counts(table(spark, d, "documents"))


# RE2's word boundary knows ASCII only; other letters become x, other characters blanks.
_ASCII = f"regexp_replace(regexp_replace({TXT}, '[^\\p{{L}}\\p{{N}}\\x00-\\x7f]', ' ', 'g'), '[^\\x00-\\x7f]', 'x', 'g')"


@add("social_legal_counts", f"select doc_id, {s_count(_ASCII, C.SOCIAL)} social, {s_count(_ASCII, C.LEGAL)} legal from documents")
def _(spark, d):
    return signals.pattern_counts(table(spark, d, "documents"))


_LP = f"""with w as (select doc_id, unnest(regexp_extract_all(lower({TXT}), {q('[a-z' + chr(39) + ']+')})) word from documents), v as materialized (select word, count(*) c from w group by 1),
 z as (select sum(c) n, count(*) v from v), m as (select doc_id, avg(ln((c + 1) / (z.n + z.v))) m from w join v using (word), z group by 1), s as (select doc_id, round(coalesce(m, {C.NO_WORDS_LOG_PROB}), 6) log_prob from documents left join m using (doc_id))"""


@add("unigram_log_prob", _LP + " select doc_id, log_prob from s")
def _(spark, d):
    return lm.unigram_scores(table(spark, d, "documents"))


@add("perplexity_filter", _LP + " select doc_id, round(exp(-log_prob), 4) perplexity, case when round(exp(-log_prob), 4) < 10 or round(exp(-log_prob), 4) > 100000 then 'perplexity_outlier' else 'kept' end status from s")
def _(spark, d):
    return lm.perplexity_status(table(spark, d, "documents"))


@add(
    "ngram_perplexity",
    f"""with w as materialized (select doc_id, regexp_extract_all(lower({TXT}), {q('[a-z' + chr(39) + ']+')}) w from documents),
 t as materialized (select doc_id, w[i] w1, w[i-1:i] w2, w[i-2:i] w3, w[i-1:i-1] h1, w[i-2:i-1] h2, i from w x, lateral (select unnest(range(1, len(x.w) + 1)) i)),
 u as materialized (select w1, count(*) c from t group by 1), b as materialized (select w2, count(*) c from t where i > 1 group by 1), g as materialized (select w3, count(*) c from t where i > 2 group by 1),
 f1 as materialized (select w2[1:1] h1, sum(c) f, count(*) k from b group by 1), f2 as materialized (select w3[1:2] h2, sum(c) f, count(*) k from g group by 1), z as (select sum(c) n, count(*) v from u),
 p1 as (select t.*, (u.c + 1) / (z.n + z.v + 1) p from t join u using (w1), z),
 p2 as (select p1.* replace (case when i > 1 and f1.f > 0 then (coalesce(b.c, 0) + f1.k * p) / (f1.f + f1.k) else p end as p) from p1 left join b using (w2) left join f1 using (h1)),
 p3 as (select doc_id, case when i > 2 and f2.f > 0 then (coalesce(g.c, 0) + f2.k * p) / (f2.f + f2.k) else p end p from p2 left join g using (w3) left join f2 using (h2))
 select doc_id, round(exp(-avg(ln(p))), 3) perplexity from w left join p3 using (doc_id) where len(w) > 0 group by 1""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return lm.perplexity(docs, lm.ngram_counts(docs)).where(F.col("perplexity") < float("inf")).select("doc_id", F.round("perplexity", 3).alias("perplexity"))


# ---- runs ------------------------------------------------------------------------------------------------------------
_RUN = "with m as materialized (select * from (select *, row_number() over (partition by run_name, line_no order by coalesce(logged_at, timestamptz '1970-01-01 00:00:00+00') desc) rn from run_metrics) where rn = 1)"


def s_nan(c):
    return f"(case when isnan({c}) then null else {c} end)"


def metrics(spark, d):
    return table(spark, d, "run_metrics")


@add(
    "series_ema",
    _RUN.replace("with m", "with recursive m") + f", s as materialized (select run_name, step, {s_nan('train_loss')} x, row_number() over (partition by run_name order by line_no) k from m where record_type = 'step' and {s_nan('train_loss')} is not null),"
    " e as (select run_name, k, step, x, x ema from s where k = 1 union all select s.run_name, s.k, s.step, s.x, e.ema * 0.98 + s.x * (1 - 0.98) from e join s on s.run_name = e.run_name and s.k = e.k + 1)"
    " select run_name, step, round(x, 6) train_loss, round(ema, 6) ema from e",
)
def _(spark, d):
    return runs.smoothed(metrics(spark, d))


_EVAL = _RUN + f""", a as (select *, last_value(case when record_type = 'step' then step end ignore nulls) over (partition by run_name order by line_no rows unbounded preceding) at_step from m),
 ev as (select run_name, line_no, coalesce(step, at_step) step, round({s_nan('val_loss')}, 6) val_loss, round(case when min(({s_nan('eval_train_loss')} is not null)::int) over (partition by run_name) = 1 then {s_nan('val_loss')} - {s_nan('eval_train_loss')} end, 6) gap from a where record_type = 'eval')"""


@add("eval_points", _EVAL + " select run_name, line_no, step, val_loss, gap from ev")
def _(spark, d):
    return runs.eval_points(metrics(spark, d))


@add("best_evaluations", _EVAL + " select run_name, step, val_loss from (select *, row_number() over (partition by run_name order by val_loss, step, line_no) k from ev where val_loss is not null and isfinite(val_loss)) where k <= 2")
def _(spark, d):
    return runs.best_n(metrics(spark, d))


@add("best_steps", _RUN + " select run_name, step, round(val_loss, 6) val_loss from (select *, row_number() over (partition by run_name order by line_no desc) k from m where record_type = 'best_checkpoint') where k = 1")
def _(spark, d):
    return runs.best_steps(metrics(spark, d))


@add("run_summary", _RUN + f" select run_name, count(*) filter (record_type = 'step') n_steps, max(step) last_step, round(min({s_nan('val_loss')}), 6) least_val_loss, round(avg({s_nan('tokens_per_sec')}), 4) mean_tokens_per_sec from m group by 1")
def _(spark, d):
    return runs.summary(metrics(spark, d))


@add(
    "early_stopping",
    _RUN.replace("with m", "with recursive m") + ", e as materialized (select run_name, line_no, case when isnan(val_loss) or not isfinite(val_loss) then null else val_loss end x, row_number() over (partition by run_name order by line_no) k from m where record_type = 'eval'),"
    " f as (select run_name, 0::bigint k, 'infinity'::double best, 0 bad, null::bigint stop from (select distinct run_name from e) union all"
    " select e.run_name, e.k, case when e.x < f.best then e.x else f.best end, case when e.x < f.best then 0 else f.bad + 1 end,"
    " coalesce(f.stop, case when e.x is null or (not e.x < f.best and f.bad + 1 >= 3) then e.line_no end) from f join e on e.run_name = f.run_name and e.k = f.k + 1)"
    " select run_name, max(stop)::double stop_line from f group by 1",
)
def _(spark, d):
    return runs.early_stop(metrics(spark, d)).withColumn("stop_line", F.col("stop_line").cast("double"))


@add("early_batches_loss", _RUN + f" select round(avg(a), 6) loss, round(exp(avg(a)), 6) perplexity from (select avg(x) a from (select {s_nan('train_loss')} x, line_no // 20 b from m where record_type = 'step') where x is not null group by b order by b limit 20)")
def _(spark, d):
    m = runs.lines(metrics(spark, d)).where("record_type = 'step'").select(F.floor(F.col("line_no") / 20).alias("batch_id"), runs.nan_free("train_loss").alias("loss"))
    return runs.batch_perplexity(m.where("loss is not null"), 20)


def s_last(n):
    return f"(partition by run_name order by line_no rows {n - 1} preceding)"


@add(
    "run_alerts",
    _RUN + f", s as (select run_name, line_no, step, record_type t, {s_nan('grad_norm')} g, {s_nan('train_loss')} x, {s_nan('lr')} r, {s_nan('val_loss')} v, {s_nan('eval_train_loss')} e from m)"
    f" select run_name, line_no, 'gradient' alert from (select *, max(g) over {s_last(3)} h from s where t = 'step' and g is not null) where h > 10"
    f" union all select run_name, line_no, 'loss' from (select *, min(x) over {s_last(3)} h from s where t = 'step' and x is not null and step >= 200) where h > 7"
    f" union all select run_name, line_no, 'rate' from (select *, max(abs(r)) over {s_last(3)} h from s where t = 'step' and r is not null) where h = 0 and step > 20"
    " union all select run_name, line_no, 'overfitting' from (select *, v - e gap, lag(v - e, 2) over (partition by run_name order by line_no) before from s where t = 'eval' and v is not null and e is not null) where gap > 0.5 and gap > before"
    f" union all select run_name, line_no, 'stagnation' from (select *, count(v) over {s_last(5)} k, max(v) over {s_last(5)} - min(v) over {s_last(5)} d from s where t = 'eval' and v is not null) where k = 5 and d < 0.001",
)
def _(spark, d):
    return runs.alerts(metrics(spark, d))


@add(
    "loss_curve",
    _RUN + f", p as (select step, {s_nan('train_loss')} l from m where record_type = 'step' and step is not null and {s_nan('train_loss')} is not null), e as (select min(step) s0, max(step) s1, min(l) l0, max(l) l1 from p)"
    " select distinct floor((step - s0) / greatest(s1 - s0, 1) * 49)::bigint x, floor((l - l0) / case when l1 = l0 then 1 else l1 - l0 end * 7)::bigint y from p, e",
)
def _(spark, d):
    return runs.curve(runs.lines(metrics(spark, d)).where("record_type = 'step'").select("step", F.col("train_loss").alias("loss")))


@add(
    "retained_checkpoints",
    _EVAL + ", f as (select run_name, line_no, step, case when isfinite(val_loss) then val_loss end x from ev)"
    " select run_name, line_no, step, x is not null and (select count(*) from f o where o.run_name = f.run_name and o.line_no < f.line_no and o.x <= f.x) < 2 kept from f",
)
def _(spark, d):
    return runs.retained_best(runs.eval_points(metrics(spark, d)))


_TRIALS = _RUN + f""", t as (select row_number() over (order by run_name) number, run_name, case when bool_or(record_type = 'best_checkpoint') then 'COMPLETE' when bool_or(record_type = 'eval') then 'PRUNED' else 'FAIL' end state,
 round(min(case when isfinite(val_loss) then {s_nan('val_loss')} end), 6) as value from m group by run_name)"""


def study(spark, d):
    """The runs as trials of a study."""
    from pyspark.sql.window import Window

    m, has = runs.lines(metrics(spark, d)), lambda t: F.bool_or(F.col("record_type") == t)
    t = m.groupBy("run_name").agg(
        F.when(has("best_checkpoint"), "COMPLETE").when(has("eval"), "PRUNED").otherwise("FAIL").alias("state"),
        F.round(F.min(F.when(F.abs("val_loss") < float("inf"), runs.nan_free("val_loss"))), 6).alias("value"),
    )
    return t.withColumn("number", F.row_number().over(Window.orderBy("run_name")).cast("bigint"))  # a row a run


@add("trial_states", _TRIALS + " select state, count(*) n, min(value) best from t group by 1")
def _(spark, d):
    return trials.by_state(study(spark, d))


@add("best_trials", _TRIALS + " select row_number() over (order by value nulls last, number) rank, number, run_name, value from t where state = 'COMPLETE' order by 1 limit 5")
def _(spark, d):
    return trials.best(study(spark, d)).select("rank", "number", "run_name", "value")


_PRESETS = "(select 64 * k d_model, case when k % 3 = 0 then 'd_model=' || 32 * k || ',n_layers=4,n_heads=4,d_ff=' || 96 * k end p, 0.001 * k lr from range(1, 13) t(k))"


@add(
    "trial_parameters",
    f"select d_model, d_ff, round(lr * 0.1, 9) min_lr, n_layers from (select case when p is null then d_model else regexp_extract(p, 'd_model=([0-9]+)', 1)::bigint end d_model, lr, case when p is not null then 4::bigint end n_layers,"
    f" case when p is null then (d_model * 8 // 3) + (d_model * 8 // 3) % 2 else regexp_extract(p, 'd_ff=([0-9]+)', 1)::bigint end d_ff from {_PRESETS}) where n_layers is not null",
)
def _(spark, d):
    k = F.col("id")
    preset = F.when(k % 3 == 0, trials.preset(32 * k, F.lit(4), F.lit(4), 96 * k))
    t = spark.range(1, 13).select((64 * k).alias("d_model"), preset.alias("architecture_preset"), (0.001 * k).alias("learning_rate"))
    return trials.resolved(t).where("n_layers is not null").select("d_model", "d_ff", F.round("min_lr", 9).alias("min_lr"), "n_layers")


_CK = r"with c as (select distinct on (run_name, ckpt_name) *, coalesce(step, nullif(regexp_extract(ckpt_name, 'step_(\d+)', 1), '')::bigint, nullif(regexp_extract(ckpt_name, 'step(\d+)', 1), '')::bigint) at_step from checkpoints order by run_name, ckpt_name)"


@add("checkpoint_last_n", _CK + " select run_name, at_step step, ckpt_name from (select *, row_number() over (partition by run_name order by at_step desc nulls last, ckpt_name desc) k from c where ckpt_kind = 'last') where k <= 3")
def _(spark, d):
    return runs.last_n(table(spark, d, "checkpoints"))


@add("checkpoint_latest", _CK + " select run_name, ckpt_name, at_step step from c where is_valid order by run_name desc, at_step desc nulls last, (ckpt_kind = 'last') desc, mtime desc, ckpt_name limit 1")
def _(spark, d):
    return runs.latest(table(spark, d, "checkpoints"))


@add("checkpoint_listing", _CK + rf" select run_name, ckpt_name, mtime from c where ends_with(ckpt_name, '.pt') or regexp_matches(ckpt_name, {q(C.OLD_CHECKPOINT)}) order by mtime desc nulls last, run_name, ckpt_name")
def _(spark, d):
    return runs.listed(table(spark, d, "checkpoints"))


@add("checkpoint_steps", _CK.split(", coalesce")[0].replace("with c as (select distinct on (run_name, ckpt_name) *", "select distinct ckpt_name") + r", coalesce(nullif(regexp_extract(ckpt_name, 'step_(\d+)', 1), '')::bigint, nullif(regexp_extract(ckpt_name, 'step(\d+)', 1), '')::bigint) step from checkpoints")
def _(spark, d):
    return table(spark, d, "checkpoints").select("ckpt_name", runs.step_of(F.col("ckpt_name")).alias("step")).distinct()


@add("batch_perplexity", _RUN + f" select round(avg(a), 6) loss, round(exp(avg(a)), 6) perplexity from (select avg(x) a from (select {s_nan('train_loss')} x, line_no // 20 b, run_name from m where record_type = 'step') where x is not null group by run_name, b)")
def _(spark, d):
    m = runs.lines(metrics(spark, d)).where("record_type = 'step'").select(F.concat_ws("/", "run_name", F.floor(F.col("line_no") / 20).cast("string")).alias("batch_id"), runs.nan_free("train_loss").alias("loss"))
    return runs.batch_perplexity(m.where("loss is not null"))


@add("run_ranking", _RUN + f" select run_name, v val_loss, row_number() over (order by v nulls last, run_name) rank from (select run_name, case when (row_number() over (order by run_name)) % 3 = 0 then null else v end v from (select run_name, round(min({s_nan('val_loss')}), 6) v from m group by 1))")
def _(spark, d):
    from pyspark.sql.window import Window

    s = runs.summary(metrics(spark, d)).select("run_name", F.col("least_val_loss").alias("val_loss"))
    third = F.row_number().over(Window.orderBy("run_name")) % 3 == 0  # a row a run
    new = s.withColumn("t", third).where("t").select("run_name", F.lit(None).cast("double").alias("val_loss"))
    return runs.upsert_ranking(s, new, "run_name", "val_loss").withColumn("rank", F.col("rank").cast("bigint"))


# ---- computed tables -------------------------------------------------------------------------------------------------
@add("lr_schedule_wsd", "select s step, round(case when s < 5 then 1.0 * (s + 1) / 5 when s < 18 then 1.0 else 1.0 - 0.9 * (s - 17) / 2 end, 9) lr from range(20) t(s)")
def _(spark, d):
    return training.lr_schedule(spark, "wsd", 5, 20, 1.0, 0.1)


@add("lr_schedule_cosine", "select s step, round(case when s < 5 then 1.0 * (s + 1) / 5 else 0.1 + 0.5 * 0.9 * (1 + cos(pi() * least((s - 5) / 14, 1.0))) end, 9) lr from range(20) t(s)")
def _(spark, d):
    return training.lr_schedule(spark, "cosine", 5, 20, 1.0, 0.1)


_GRID = ((128, 160, 192), (2, 3, 4), (2, 4, 5), (272, 320, 384), 8_500_000, 8_750_000)


@add(
    "architecture_grid",
    f"select *, row_number() over (order by abs(n_params - {(_GRID[4] + _GRID[5]) / 2}), d_model, n_layers, n_heads, d_ff) rank from (select d_model, n_layers, n_heads, d_ff, cast(50258 * d_model + n_layers * (4 * d_model * d_model + 3 * d_model * d_ff + 2 * d_model + 2 * (d_model // n_heads)) as bigint) n_params"
    f" from (select unnest({list(_GRID[0])})::bigint d_model), (select unnest({list(_GRID[1])})::bigint n_layers), (select unnest({list(_GRID[2])})::bigint n_heads), (select unnest({list(_GRID[3])})::bigint d_ff)) where d_model % n_heads = 0 and (d_model // n_heads) % 2 = 0 and n_params between {_GRID[4]} and {_GRID[5]}",
)
def _(spark, d):
    return training.architecture_grid(spark, 50258, *_GRID).withColumn("rank", F.col("rank").cast("bigint"))


@add("scaling_law", "select n * 1000000 n_params, t * 1000000 n_tokens, round(l, 6) loss, round(exp(l), 4) perplexity, round(exp(-l), 6) accuracy from (select n, t, 1.69 + pow(n * 1e6 / 6.7e3, -0.34) + pow(t * 1e6 / 1.8e5, -0.28) l from (select unnest([9, 36])::bigint n), (select unnest([800, 4140, 8280])::bigint t))")
def _(spark, d):
    return training.scaling_law(spark.createDataFrame([(n * 1_000_000, t * 1_000_000) for n in (9, 36) for t in (800, 4140, 8280)], "n_params bigint, n_tokens bigint"))


@add(
    "nucleus_filter",
    "with g as (select n_name, n_regionkey g, count(*) * 0.05 x from customer join nation on c_nationkey = n_nationkey group by 1, 2), p as (select g, n_name, exp(x - max(x) over (partition by g)) / sum(exp(x)) over (partition by g) * exp(max(x) over (partition by g)) p, x from g),"
    " s as (select *, sum(p) over (partition by g order by x desc, n_name rows unbounded preceding) - p b from p) select g as \"group\", n_name item, round(p, 6) prob from s where b <= 0.8",
)
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg((F.count("*") * 0.05).alias("logit"))
    g = c.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("item"), "logit")
    return training.nucleus(g, 0.8)


@add(
    "prompt_build",
    "select user_id conv_id, string_agg(case when k % 2 = 1 then 'User: ' else 'Assistant: ' end || event_type, chr(10) order by k) || chr(10) || 'Assistant:' prompt from (select user_id, event_type, row_number() over (partition by user_id order by event_id) k from events) group by 1",
)
def _(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return training.prompt(e.select(F.col("user_id").alias("conv_id"), "turn", F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant").alias("role"), F.col("event_type").alias("text")))
