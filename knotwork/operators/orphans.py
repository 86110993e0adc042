"""References to records that do not exist, never existed or came later.

Skew-aware split. References are first reduced to one row for each (key,
period). Keys that hold a large share of all references are checked against a
broadcast of their targets: at most ``MOST_HEAVY`` keys, one target row each,
whatever the size of the tables. The remaining keys go through one shuffle
join. Both parts are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.heavy import heavy_keys
from knotwork.functions.paths import uniform_path

#: Keys checked by broadcast: at most so many, with one target row each.
MOST_HEAVY = 256
#: A key with at least this share of all references is heavy.
HEAVY_SHARE = 1 / 512


def _key(file, name):
    return F.concat(file, F.lit("\u0000"), name)


def anchor_targets(nodes: DataFrame) -> DataFrame:
    """key, first_at, present, undated: one row for each (file, name) and one for each file.

    Rows without a file never match, rows without a name only as part of their
    file. A null ``indexed_at`` is no arrival; a target that has one is never
    late. Repeated deliveries change nothing.
    """
    file, name = F.col("file"), F.col("name")
    return (
        nodes.where(file.isNotNull())
        .select(
            F.explode(F.array(_key(file, F.lit("")), F.when(name != "", _key(file, name)))).alias("key"),
            "indexed_at",
            F.col("removed_at").isNull().cast("int").alias("here"),
        )
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("indexed_at").alias("first_at"),
            F.max("here").alias("present"),
            F.max(F.col("indexed_at").isNull().cast("int")).alias("undated"),
        )
    )


def anchor_references(anchors: DataFrame, decisions: DataFrame) -> DataFrame:
    """anchor_id, anchor_kind, key, t: each anchor once, with the time of its decision.

    Rows without anchor_id, and anchors of a kind other than ``function`` and
    ``file``, are left out. Of a repeated anchor_id with different contents the
    least row counts, of a repeated decision its earliest time. An anchor whose
    decision is unknown or undated has a null t. A null file gives a null key,
    which has no target; so has a function anchor without a name.
    """
    file = uniform_path(F.col("anchor_file"))
    name = F.coalesce(F.col("anchor_name"), F.lit(""))
    a = (
        anchors.where(F.col("anchor_id").isNotNull() & F.col("anchor_kind").isin("function", "file"))
        .select(
            "anchor_id",
            F.col("decision_id"),
            F.col("anchor_kind"),
            F.when(F.col("anchor_kind") == "file", _key(file, F.lit(""))).when(name != "", _key(file, name)).alias("key"),
        )
        .groupBy("anchor_id")
        .agg(F.min(F.struct("decision_id", "anchor_kind", "key")).alias("r"))
        .select("anchor_id", "r.*")
    )
    when = (
        decisions.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("decision_id"))
        .agg(F.min(F.to_timestamp("created_at")).alias("t"))
    )
    return a.join(when, "decision_id", "left").select("anchor_id", "anchor_kind", "key", "t", F.date_format("t", "yyyy-MM").alias("month"))


def _verdict():
    """Of a key and month: the fault of all its references, ``part`` if only some may be late, null if none."""
    return (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("present") == 0, "deleted")
        .when((F.col("undated") == 1) | F.col("max_t").isNull() | (F.col("first_at") <= F.col("min_t")), None)
        .when((F.col("first_at") > F.col("max_t")) & (F.col("n") == F.col("dated")), "late")
        .when(F.col("first_at") > F.col("min_t"), "part")
    )


def _judged(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    return (
        keyed.groupBy("key", "anchor_kind", "month")
        .agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("dated"), F.min("t").alias("min_t"), F.max("t").alias("max_t"))
        .join(targets, "key", "left")
        .withColumn("verdict", _verdict())
        .where(F.col("verdict").isNotNull())
        .select("key", "anchor_kind", "month", "n", "first_at", "verdict")
    )


def _split(refs: DataFrame, anchors: DataFrame, nodes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(references, verdicts of their keys and months) of the heavy and the remaining keys; those without a key are missing and meet nothing."""
    raw = anchors.select(
        _key(uniform_path(F.col("anchor_file")), F.when(F.col("anchor_kind") == "function", F.coalesce(F.col("anchor_name"), F.lit(""))).otherwise("")).alias("key")
    )
    heavy = heavy_keys(raw, "key", MOST_HEAVY, HEAVY_SHARE)
    targets = anchor_targets(nodes)
    hot = F.col("key").isin(heavy) if heavy else F.lit(False)
    # one exchange by key carries the light references to the check and, reused, to the rows at fault
    light = refs.where(F.col("key").isNotNull() & ~hot).repartition("key")
    out = [(light, _judged(light, targets.where(~hot)))]
    if heavy:
        warm = refs.where(hot)
        # reduced to a row for each heavy key, kind and month: at most MOST_HEAVY keys, so they go to the references and not these to them
        out.append((warm, F.broadcast(_judged(warm, F.broadcast(targets.where(hot))))))
    return out


def orphan_anchors(anchors: DataFrame, decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """anchor_id, anchor_kind, month, orphan_kind of every anchor at fault.

    orphan_kind is the first that holds: ``missing`` (the target has no rows),
    ``deleted`` (all its rows are removed), ``late`` (its earliest arrival is
    after the decision). An anchor without a time is never late. Empty tables
    give what these rules say: without nodes every anchor is missing.
    """
    parts = []
    every = anchor_references(anchors, decisions)
    for refs, verdicts in _split(every, anchors, nodes):
        v = verdicts.select(F.col("key").alias("k"), F.col("anchor_kind").alias("vk"), F.col("month").alias("vm"), "first_at", "verdict")  # keeps the hint
        same = (F.col("key") == F.col("k")) & (F.col("anchor_kind") == F.col("vk")) & F.col("month").eqNullSafe(F.col("vm"))
        parts.append(refs.join(v, same).where((F.col("verdict") != "part") | (F.col("first_at") > F.col("t"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind = F.when(F.col("verdict") == "part", "late").otherwise(F.col("verdict"))
    keyless = every.where(F.col("key").isNull()).select("anchor_id", "anchor_kind", "month", F.lit("missing").alias("orphan_kind"))
    return out.select("anchor_id", "anchor_kind", "month", kind.alias("orphan_kind")).unionByName(keyless)


def orphan_report(anchors: DataFrame, decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """anchor_kind, month, orphan_kind, n_anchors: orphans by kind of anchor and month of the decision.

    Whole keys and months are counted from their reduced row; only those in
    which some anchors came before the target and some after are looked at one
    by one. Anchors without a time stand under a null month.
    """
    every = anchor_references(anchors, decisions)
    parts = [every.where(F.col("key").isNull()).select("anchor_kind", "month", F.lit("missing").alias("orphan_kind"), F.lit(1).cast("long").alias("n"))]
    for refs, verdicts in _split(every, anchors, nodes):
        parts.append(verdicts.where(F.col("verdict") != "part").select("anchor_kind", "month", F.col("verdict").alias("orphan_kind"), "n"))
        v = verdicts.where(F.col("verdict") == "part").select("key", "anchor_kind", "month", "first_at")
        parts.append(
            refs.join(v, ["key", "anchor_kind", "month"])
            .where(F.col("first_at") > F.col("t"))
            .select("anchor_kind", "month", F.lit("late").alias("orphan_kind"), F.lit(1).cast("long").alias("n"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("anchor_kind", "month", "orphan_kind").agg(F.sum("n").alias("n_anchors"))
