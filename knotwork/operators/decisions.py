"""Decisions, their anchors and keywords: look-ups, liveness, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_decisions(decisions: DataFrame) -> DataFrame:
    """One row for each id, of repeated deliveries the least."""
    columns = ["decision", "session_id", "created_at"]
    return decisions.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")


def distinct_anchors(anchors: DataFrame) -> DataFrame:
    """The four columns of an anchor, each combination once; the name of a file anchor is ''."""
    return anchors.select("decision_id", "anchor_kind", "anchor_file", F.coalesce("anchor_name", F.lit("")).alias("anchor_name")).distinct()


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.select("decision_id", "keyword").where(F.col("keyword").isNotNull()).distinct()


def newest_first(decisions: DataFrame) -> DataFrame:
    """By time, the newest first; equal times by id."""
    return decisions.orderBy(F.desc("created_at"), "id")


def decisions_for_function(decisions: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file, name) with the decisions on that function or on its whole file, each once."""
    a = anchors.select("decision_id", "anchor_kind", F.col("anchor_file").alias("file"), "anchor_name")
    hit = wanted.join(a, "file").where((F.col("anchor_kind") == "file") | (F.col("anchor_name") == F.col("name"))).select("file", "name", "decision_id").distinct()
    return hit.join(decisions.withColumnRenamed("id", "decision_id"), "decision_id")


def decisions_for_file(decisions: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file) with the decisions that have any anchor on it, each once."""
    a = anchors.select("decision_id", F.col("anchor_file").alias("file"))
    return wanted.join(a, "file").distinct().join(decisions.withColumnRenamed("id", "decision_id"), "decision_id")


def decisions_by_keyword(decisions: DataFrame, keywords: DataFrame, keyword: str) -> DataFrame:
    """Decisions that hold the keyword, as a semi join."""
    k = keywords.where(F.col("keyword") == keyword).select("decision_id")
    return decisions.join(k, decisions["id"] == k["decision_id"], "left_semi")


def anchors_with_liveness(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors with live: a function anchor lives if the function is there, a file anchor if any function of the file is."""
    names = nodes.select(F.col("file").alias("anchor_file"), F.col("name").alias("anchor_name")).distinct().withColumn("has_name", F.lit(True))
    files = nodes.select(F.col("file").alias("anchor_file")).distinct().withColumn("has_file", F.lit(True))
    live = F.when(F.col("anchor_kind") == "function", F.coalesce("has_name", F.lit(False))).otherwise(F.coalesce("has_file", F.lit(False)))
    return anchors.join(names, ["anchor_file", "anchor_name"], "left").join(files, "anchor_file", "left").select("decision_id", "anchor_kind", "anchor_file", "anchor_name", live.alias("live"))


def live_counts(anchors_live: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row: total and live of the anchors of the decisions in ids (id), of all without ids; 0 and 0 if none."""
    return _listed(anchors_live, ids).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("live").cast("long")), F.lit(0)).alias("live"))


def _listed(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return df if ids is None else df.join(ids.select(F.col("id").alias("decision_id")).distinct(), "decision_id", "left_semi")


def keywords_of(keywords: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """decision_id, keywords in order, of the decisions in ids (id), of all without ids."""
    return _listed(keywords, ids).groupBy("decision_id").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))


def anchors_of(anchors_live: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """decision_id, anchors: kind, file, name, live, in that order; the name of a file anchor is null. Of the decisions in ids (id), of all without ids."""
    a = F.struct(F.col("anchor_kind").alias("kind"), F.col("anchor_file").alias("file"), F.when(F.col("anchor_kind") == "function", F.col("anchor_name")).alias("name"), "live")
    return _listed(anchors_live, ids).groupBy("decision_id").agg(F.array_sort(F.collect_list(a)).alias("anchors"))


def vocabulary(keywords: DataFrame, limit: int | None = None) -> DataFrame:
    """keyword, n: the most used first, equals by keyword; at most limit."""
    v = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword")
    return v if limit is None else v.limit(limit)
