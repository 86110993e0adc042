"""Schemas and value domains of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

# Why a call stays unresolved, in the order of reports.
REASONS = ("member_chain", "external", "default_import", "namespace_import", "barrel_miss", "unknown_bare")

FUNCTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("calls", T.ArrayType(T.StringType())),
    ]
)
IMPORT = T.StructType(
    [
        T.StructField("local_name", T.StringType()),
        T.StructField("imported_name", T.StringType()),
        T.StructField("module_specifier", T.StringType()),
        T.StructField("is_default", T.BooleanType()),
        T.StructField("is_namespace", T.BooleanType()),
    ]
)
PARSED_FILE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("functions", T.ArrayType(FUNCTION)),
        T.StructField("imports", T.ArrayType(IMPORT)),
        T.StructField("had_parse_errors", T.BooleanType()),
        T.StructField("duplicate_function_names", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
NODE = "id long, file string, name string, kind string, start_line int, end_line int"
EDGE = "source_id long, target_id long, kind string, count long"
DECISION = "id long, decision string, session_id string, created_at string"
ANCHOR = "decision_id long, anchor_kind string, anchor_file string, anchor_name string"
KEYWORD = "decision_id long, keyword string"
TABLES = {"nodes": NODE, "edges": EDGE, "decisions": DECISION, "decision_anchors": ANCHOR, "decision_keywords": KEYWORD}
