"""Queries over the training-data problems; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import cooccur, handwritten, lookalike, neardup, packing, syntax, termfreq, tokenise
from knotwork.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_keywords")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "decisions"), "id", "decision", threshold=0.6)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, d, "decisions"), "id", "decision", threshold=0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marked = termfreq.marked_terms(_keywords(spark, d), "decision_id", "keyword")
    return marked.where(F.col("mark").isNotNull()).select(F.col("term").alias("keyword"), "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    marked = termfreq.marked_terms(_keywords(spark, d), "decision_id", "keyword")
    return marked.select(F.col("term").alias("keyword"), "n_rows", "n_records", "total_records", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "parsed_files")).select("file")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_lift(spark, d).select("keyword_a", "keyword_b")


def p4_lift(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.pair_lift(_keywords(spark, d), "decision_id", "keyword", least_together=5, lift=4)
    return pairs.select(F.col("item_a").alias("keyword_a"), F.col("item_b").alias("keyword_b"), "n_ab", "n_a", "n_b", "n", "lift")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "parsed_files"), table(spark, d, "pipeline_results")).select("file")


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "parsed_files"), table(spark, d, "pipeline_results"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "parsed_files"), table(spark, d, "pipeline_results"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_once(table(spark, d, "documents"), "doc_id", "text")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "context_windows").select("window_id", F.col("capacity_tokens").alias("capacity"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenise.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, _windows(spark, d))


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.room_left(p8_windows(spark, d), _windows(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


def p9_uniform(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.uniform_text(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p2_found, p2_counts, p3_found, p4_found, p4_lift, p6_found, p6_faults, p6_rates,
        p7_ids, p8_windows, p8_room, p9_found, p9_classes, p9_uniform,
    )
}

#: Space of any kind, for DuckDB's regular expressions.
_TRIM = r"regexp_replace(regexp_replace(keyword, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')"
_TERMS = f"k as (select decision_id, lower({_TRIM}) as keyword from decision_keywords), n as (select count(distinct decision_id) as n from decision_keywords)"
_COUNTS = f"with {_TERMS}, c as (select keyword, count(*) as n_rows, count(distinct decision_id) as n_records from k where keyword is not null group by keyword), m as (select keyword, n_rows, n_records, n as total_records, case when n_records < 3 then 'rare' when n_records * 20 > n then 'common' end as mark from c, n)"
_LIFT = f"""with {_TERMS}, u as (select distinct decision_id, keyword from k where keyword is not null and decision_id is not null),
c as (select keyword, count(*) as n from u group by keyword),
p as (select a.keyword as keyword_a, b.keyword as keyword_b, count(*) as n_ab from u a join u b on a.decision_id = b.decision_id and a.keyword < b.keyword group by 1, 2),
r as (select keyword_a, keyword_b, n_ab, x.n as n_a, y.n as n_b, n.n as n, n_ab * n.n / (x.n * y.n) as lift
 from p join c x on x.keyword = keyword_a join c y on y.keyword = keyword_b cross join n where n_ab >= 5 and n_ab * n.n >= 4 * x.n * y.n)"""
_SETS = """with d as (select id, min(decision) as t from decisions where id is not null and decision is not null group by id),
w as (select distinct id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) as word from d),
s as (select id, count(*) as n from w group by id),
o as (select a.id as id_a, b.id as id_b, count(*) as both_n from w a join w b on a.word = b.word and a.id < b.id group by 1, 2),
f as (select id_a, id_b from o join s x on x.id = id_a join s y on y.id = id_b where both_n * 10 >= 6 * (x.n + y.n - both_n)
 union select a.id, b.id from d a join d b on a.t = b.t and a.id < b.id)"""

ORACLES: dict[str, str] = {
    "p1_found": f"{_SETS} select id_a, id_b from f",
    "p1_classes": f"""{_SETS}, k as (select d.id, coalesce(string_agg(word, ' ' order by word), '') as g from d left join w using (id) group by d.id),
l as (select id_a as id, id_b as other from f union all select id_b, id_a from f)
select k.id, min(k.id) over (partition by g) as class_id, (select count(*) from l where l.id = k.id) as n_links from k""",
    "p2_found": f"{_COUNTS} select keyword, mark from m where mark is not null",
    "p2_counts": f"{_COUNTS} select keyword, n_rows, n_records, total_records, mark from m",
    "p4_found": f"{_LIFT} select keyword_a, keyword_b from r",
    "p4_lift": f"{_LIFT} select * from r",
}
