"""Queries pN_... of the problems; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import language, leakage, mixing, neardup, quality, residue, spans, subjects as subject_areas
from lexmill.plans.stage import spread

Query = Callable[[SparkSession, str], DataFrame]


def table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def texts(name: str):
    """A table of texts, dealt out over all cores if it is a single small file."""
    return lambda spark, d: spread(spark.read.parquet(f"{d}/{name}.parquet"))


web, labels, raters, areas = texts("openwebtext_10k"), table("detect_language_batch"), table("subject_labels"), table("subject_areas")
documents, benchmark, targets = texts("documents"), table("benchmark"), table("mix_targets")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: subject_areas.found(web(s, d), raters(s, d), areas(s, d), labels(s, d)),
        "p1_subjects": lambda s, d: subject_areas.assigned(web(s, d), raters(s, d), areas(s, d), labels(s, d)),
        "p1_composition": lambda s, d: subject_areas.composition(web(s, d), raters(s, d), areas(s, d), labels(s, d)),
        "p2_found": lambda s, d: neardup.found(web(s, d)),
        "p2_groups": lambda s, d: neardup.groups(web(s, d)),
        "p2_pairs": lambda s, d: neardup.pairs(web(s, d)),
        "p3_found": lambda s, d: language.found(web(s, d), labels(s, d)),
        "p3_segments": lambda s, d: language.segments(web(s, d), labels(s, d)),
        "p3_languages": lambda s, d: language.languages(web(s, d), labels(s, d)),
        "p4_found": lambda s, d: quality.found(web(s, d), labels(s, d)),
        "p4_statistics": lambda s, d: quality.measured(web(s, d), labels(s, d)),
        "p5_found": lambda s, d: residue.found(web(s, d), labels(s, d)),
        "p5_scores": lambda s, d: residue.scored(web(s, d), labels(s, d)),
        "p5_clean": lambda s, d: residue.clean(web(s, d), labels(s, d)),
        "p6_found": lambda s, d: leakage.found(documents(s, d), benchmark(s, d)),
        "p6_report": lambda s, d: leakage.leak_report(documents(s, d), benchmark(s, d)),
        "p6_items": lambda s, d: leakage.leaked_items(documents(s, d), benchmark(s, d)),
        "p7_found": lambda s, d: mixing.found(documents(s, d), targets(s, d)),
        "p7_mix": lambda s, d: mixing.Mix(documents(s, d), targets(s, d)).documents(),
        "p7_shares": lambda s, d: mixing.Mix(documents(s, d), targets(s, d)).shares(),
        "p8_found": lambda s, d: spans.spans(documents(s, d)),
        "p8_share": lambda s, d: spans.shared_share(documents(s, d)),
    }


_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _runs(table: str, key: str, n: int, least: int) -> str:
    w = _WORDS.format("text")
    return (
        f"(select distinct {key}, array_to_string(w[i:i+{n - 1}], ' ') g from (select {key}, {w} w from {table} where text is not null) x, lateral (select unnest(range(1, len(x.w) - {n - 2})) i) where len(w) >= {least})"
    )


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it over whole tables: plain set and window statements, none of the operators' methods."""
    return {
        "p2_found": f"""with s as materialized {_runs("openwebtext_10k", "row_id", 3, 30)}, n as (select row_id, count(*) n from s group by 1),
 o as (select a.row_id x, b.row_id y, count(*) k from s a join s b on a.g = b.g and a.row_id < b.row_id group by 1, 2)
 select x row_id_a, y row_id_b from o join n p on p.row_id = x join n q on q.row_id = y where 2 * k >= least(p.n, q.n)""",
        "p6_found": f"select distinct doc_id, item_id from {_runs('documents', 'doc_id', 12, 12)} join {_runs('benchmark', 'item_id', 12, 12)} using (g)",
        "p8_found": """with w as materialized (select doc_id, i - 1 s, md5(text[i:i+399]) h from documents, lateral (select unnest(range(1, length(text) - 398)) i)),
 k as (select distinct doc_id, s from w where h in (select h from w group by h having min(doc_id) <> max(doc_id))),
 n as (select *, case when s <= lag(s) over (partition by doc_id order by s) + 400 then 0 else 1 end first from k),
 r as (select *, sum(first) over (partition by doc_id order by s) part from n)
 select doc_id, min(s) span_start, max(s) + 400 span_end from r group by doc_id, part""",
    }
