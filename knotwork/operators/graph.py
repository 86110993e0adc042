"""Nodes and edges: upserts, look-ups, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut


def upsert_nodes(nodes: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes after the upsert, (ord, id) of every input row).

    inputs has ord, file, name, kind, start_line, end_line. A known (file,
    name) keeps its id and gets the lines of its last input row; a new one gets
    the next id in order of its first input row.
    """
    last = inputs.groupBy("file", "name").agg(F.max_by(F.struct("kind", "start_line", "end_line"), "ord").alias("new"), F.min("ord").alias("first_ord"))
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    merged = nodes.join(last, ["file", "name"], "full")
    fresh = merged.where(F.col("id").isNull()).select("file", "name", "new", "first_ord")
    # dense ids without a global window: order by range, count by partition
    numbered = _numbered(fresh, "first_ord").crossJoin(F.broadcast(top)).select("file", "name", (F.col("top") + F.col("n")).alias("id"), "new.*")
    kept = merged.where(F.col("id").isNotNull()).select(
        "file", "name", "id", "kind", F.coalesce("new.start_line", "start_line").alias("start_line"), F.coalesce("new.end_line", "end_line").alias("end_line")
    )
    columns = ["id", "file", "name", "kind", "start_line", "end_line"]
    after = kept.select(*columns).unionByName(numbered.select(*columns))
    return after, inputs.select("ord", "file", "name").join(after.select("file", "name", "id"), ["file", "name"]).select("ord", "id")


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n from 1 in the order: ranks in ranges, and offsets of the ranges.

    The ranges are written before they are counted, so that both uses see the
    same ones whatever is computed again.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # one row for each partition
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return local.join(F.broadcast(before), "_p").withColumn("n", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def insert_edges(edges: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every input row adds 1 to the count of its (source_id, target_id, kind)."""
    return (
        edges.select("source_id", "target_id", "kind", "count")
        .unionByName(inputs.select("source_id", "target_id", "kind", F.lit(1).cast("long").alias("count")))
        .groupBy("source_id", "target_id", "kind")
        .agg(F.sum("count").alias("count"))
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node; a write with any is refused."""
    ids = nodes.select("id")
    a = edges.join(ids, edges["source_id"] == ids["id"], "left_anti")
    b = edges.join(ids, edges["target_id"] == ids["id"], "left_anti")
    return a.unionByName(b).distinct()


def cascade_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are still there."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source_id"] == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")


def cascade_children(children: DataFrame, decisions: DataFrame) -> DataFrame:
    """Anchors or keywords of decisions that are still there."""
    ids = decisions.select(F.col("id").alias("_id")).distinct()
    return children.join(ids, F.col("decision_id") == F.col("_id"), "left_semi")


def node_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def nodes_by_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file)


def edges_from(edges: DataFrame, source_id: int) -> DataFrame:
    return edges.where(F.col("source_id") == source_id)


def edges_to(edges: DataFrame, target_id: int) -> DataFrame:
    return edges.where(F.col("target_id") == target_id)


def innermost(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (file, line, and more) with the shortest function around the line; ties go to the lesser name.

    Probes without one are left out. A range condition on top of an equal file.
    """
    n = nodes.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    found = probes.join(n, (F.col("file") == F.col("_f")) & (F.col("line") >= F.col("_s")) & (F.col("line") <= F.col("_e")))
    return (
        found.groupBy(*probes.columns)
        .agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("span"), F.col("_n").alias("name"), F.col("_s").alias("start_line"), F.col("_e").alias("end_line"))).alias("b"))
        .select(*probes.columns, "b.name", "b.start_line", "b.end_line")
    )


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
