"""Tables of a project as immutable snapshots, published by one pointer.

Parquet has no MERGE and no transactions over several tables. A write makes new
folders for the tables it changes and then replaces the pointer file in one
step, so that readers see all of a change or nothing. One writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import decisions as D
from knotwork.operators import graph as G
from knotwork.operators import validate as V
from knotwork.schemas import TABLES


class Refused(ValueError):
    """A write that would break a rule of the tables."""


class Store:
    """root is a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        if not os.path.exists(self._pointer):
            self.write({n: spark.createDataFrame([], s) for n, s in TABLES.items()})

    @property
    def _pointer(self) -> str:
        return os.path.join(self.root, "current.json")

    def folders(self) -> dict[str, str]:
        if not os.path.exists(self._pointer):
            return {}
        with open(self._pointer, encoding="utf-8") as f:
            return json.load(f)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self.root, self.folders()[name]))

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Writes the given tables and publishes them together; the others stay."""
        version = f"{int(time.time() * 1000):x}-{uuid.uuid4().hex[:8]}"
        folders = self.folders()
        for name, df in tables.items():
            fields = [c.split(" ")[0] for c in TABLES[name].split(", ")]
            folder = f"{name}-{version}"
            df.select(*fields).write.parquet(os.path.join(self.root, folder))
            folders[name] = folder
        part = f"{self._pointer}.{version}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(folders, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self._pointer)

    def replace_graph(self, functions: DataFrame, edges: DataFrame) -> None:
        """A full rebuild: all nodes and edges anew, decisions untouched.

        functions: file, name, start_line, end_line, each (file, name) once;
        edges: source_file, source_name, target_file, target_name, count.
        """
        empty = self.spark.createDataFrame([], TABLES["nodes"])
        inputs = functions.select(F.struct("file", "name").alias("ord"), "file", "name", F.lit("function").alias("kind"), "start_line", "end_line")
        nodes, _ = G.upsert_nodes(empty, inputs)
        self.write({"nodes": nodes})
        ids = self.table("nodes").select("id", "file", "name")
        a = ids.select(F.col("id").alias("source_id"), F.col("file").alias("source_file"), F.col("name").alias("source_name"))
        b = ids.select(F.col("id").alias("target_id"), F.col("file").alias("target_file"), F.col("name").alias("target_name"))
        joined = edges.join(a, ["source_file", "source_name"]).join(b, ["target_file", "target_name"])
        self.write({"edges": joined.select("source_id", "target_id", F.lit("calls").alias("kind"), "count")})

    def upsert_nodes(self, inputs: DataFrame) -> DataFrame:
        """(ord, id) of the inputs; other kinds than function are refused."""
        if not inputs.where(F.coalesce(F.col("kind") != "function", F.lit(True))).isEmpty():
            raise Refused("kind of a node is function")
        nodes, ids = G.upsert_nodes(self.table("nodes"), inputs)
        self.write({"nodes": nodes})
        keys = self.table("nodes").select("file", "name", "id")
        return inputs.select("ord", "file", "name").join(keys, ["file", "name"]).select("ord", "id")

    def insert_edges(self, inputs: DataFrame) -> None:
        if not inputs.where(F.coalesce(F.col("kind") != "calls", F.lit(True))).isEmpty():
            raise Refused("kind of an edge is calls")
        edges = G.insert_edges(self.table("edges"), inputs)
        if not G.dangling_edges(edges, self.table("nodes")).isEmpty():
            raise Refused("an end of an edge is no node")
        self.write({"edges": edges})

    def delete_nodes(self, gone: DataFrame) -> None:
        """Removes nodes (id) and every edge at them."""
        nodes = self.table("nodes").join(gone.select("id").distinct(), "id", "left_anti")
        self.write({"nodes": nodes, "edges": G.cascade_edges(self.table("edges"), nodes)})

    def delete_decisions(self, gone: DataFrame) -> None:
        """Removes decisions (id) with their anchors and keywords."""
        decisions = self.table("decisions").join(gone.select("id").distinct(), "id", "left_anti")
        self.write(
            {
                "decisions": decisions,
                "decision_anchors": G.cascade_children(self.table("decision_anchors"), decisions),
                "decision_keywords": G.cascade_children(self.table("decision_keywords"), decisions),
            }
        )

    def add_decisions(self, rows: DataFrame, created_at: str, session_id: str | None = None) -> list[int]:
        """Ids of new decisions from (ord, decision, anchors, keywords), written with anchors and keywords together.

        A decision without anchors or keywords, an unknown kind, or a name
        that doesn't go with its kind is refused; anchors and keywords that a
        decision has twice are stored once.
        """
        bad = rows.where((F.coalesce(F.size("anchors"), F.lit(0)) < 1) | (F.coalesce(F.size("keywords"), F.lit(0)) < 1) | F.col("decision").isNull())
        if not bad.isEmpty():
            raise Refused("a decision needs a text, at least one anchor and at least one keyword")
        top = self.table("decisions").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = G._numbered(rows, "ord").withColumn("id", F.col("n") + top)
        anchors = numbered.select(F.col("id").alias("decision_id"), F.explode("anchors").alias("a")).select(
            "decision_id", F.col("a.kind").alias("anchor_kind"), F.col("a.file").alias("anchor_file"), F.when(F.col("a.kind") == "function", F.coalesce("a.name", F.lit(""))).otherwise("").alias("anchor_name")
        )
        wrong = anchors.where(~F.coalesce(F.col("anchor_kind").isin("function", "file"), F.lit(False)) | (F.col("anchor_kind") == "function") & (F.col("anchor_name") == "") | (F.coalesce("anchor_file", F.lit("")) == ""))
        if not wrong.isEmpty():
            raise Refused("kind, file and name of an anchor don't go together")
        keywords = numbered.select(F.col("id").alias("decision_id"), F.explode("keywords").alias("keyword"))
        self.write(
            {
                "decisions": self.table("decisions").unionByName(numbered.select("id", "decision", F.lit(session_id).alias("session_id"), F.lit(created_at).alias("created_at"))),
                "decision_anchors": self.table("decision_anchors").unionByName(anchors.distinct()),
                "decision_keywords": self.table("decision_keywords").unionByName(keywords.distinct()),
            }
        )
        return list(range(top + 1, self.table("decisions").agg(F.max("id")).first()[0] + 1))

    def record(self, raw: str, created_at: str, session_id: str | None = None) -> tuple[bool, str]:
        """(ok, message) of one batch of decisions as JSON: all of it is written, or nothing with all its faults."""
        batch = self.spark.createDataFrame([(0, raw)], "batch int, raw string")
        found = V.batch_faults(batch, "batch", "raw")
        message = V.fault_messages(found, "batch").first()
        if message is not None:
            return False, message["message"]
        rows = V.parsed_batches(batch, "batch", "raw").select("ord", "decision", "anchors", "keywords")
        ids = self.add_decisions(rows, created_at, session_id)
        live = D.live_counts(D.anchors_with_liveness(self.table("decision_anchors"), self.table("nodes")), self.spark.createDataFrame([(i,) for i in ids], "id long")).first()
        return True, f"recorded {len(ids)} decisions (ids: {', '.join(map(str, ids))}); anchors live: {live['live']}/{live['total']}"
