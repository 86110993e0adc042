"""Input relations of the queries, from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import ship, table

#: Relations over the star-schema tables, in SQL that Spark and DuckDB both run; {t} stands for table t.
GRAPH_SQL = {
    "g_node_inputs": "select cast(p_partkey as bigint) as ord, concat('src/', lower(replace(p_brand, '#', '')), '.ts') as file, replace(p_name, ' ', '_') as name, 'function' as kind, cast(p_partkey % 400 + 1 as int) as start_line, cast(p_partkey % 400 + 1 + p_size as int) as end_line from {part}",
    "g_imports": """select concat('src/brand', cast(s.s_suppkey % 25 + 1 as int), '.ts') as file, cast(s.s_suppkey as bigint) as ord, replace(p.p_name, ' ', '_') as local_name,
 case when s.s_nationkey % 8 = 0 then 'default' when s.s_nationkey % 8 = 1 then '*' else replace(p.p_name, ' ', '_') end as imported_name,
 s.s_nationkey % 8 = 0 as is_default, s.s_nationkey % 8 = 1 as is_namespace,
 case when s.s_nationkey % 8 = 2 then null when s.s_nationkey % 8 = 3 then 'src/index.ts' else concat('src/', lower(replace(p.p_brand, '#', '')), '.ts') end as resolved_file
 from {supplier} s join {part} p on p.p_partkey = s.s_suppkey""",
    "g_calls": """select concat('src/', lower(replace(a.p_brand, '#', '')), '.ts') as file, replace(a.p_name, ' ', '_') as caller, l.l_orderkey, l.l_linenumber,
 case when l.l_returnflag = 'R' then concat('obj.', replace(b.p_name, ' ', '_')) else replace(b.p_name, ' ', '_') end as callee
 from {lineitem} l join {part} a on a.p_partkey = l.l_partkey join {supplier} z on z.s_suppkey = l.l_suppkey join {part} b on b.p_partkey = z.s_suppkey""",
    "g_anchors": """select distinct l.l_orderkey as decision_id, case when l_linestatus = 'F' then 'function' else 'file' end as anchor_kind, case when l_returnflag = 'A' and l_suppkey % 3 = 0 then 'src/missing.ts' else concat('src/', lower(replace(p.p_brand, '#', '')), '.ts') end as anchor_file,
 case when l_linestatus <> 'F' then '' when l_returnflag = 'A' then concat('ghost_', replace(p.p_name, ' ', '_')) else replace(p.p_name, ' ', '_') end as anchor_name from {lineitem} l join {part} p on p.p_partkey = l.l_partkey""",
    "g_decisions": "select cast(o_orderkey as bigint) as id, concat('alert ', cast(o_orderkey as string), ' ', o_orderpriority) as decision, case when o_custkey % 3 = 0 then null else concat('s', cast(o_custkey % 50 as string)) end as session_id, concat(cast(cast(o_orderdate as date) as string), 'T00:00:00.000Z') as created_at from {orders}",
    "g_keywords": "select o_orderkey as decision_id, lower(c_mktsegment) as keyword from {orders} join {customer} on c_custkey = o_custkey union select o_orderkey, lower(replace(substr(o_orderpriority, 3), ' ', '-')) from {orders}",
    "s_pairs": "select distinct decision_id, anchor_file as file from {decision_anchors} where decision_id is not null and anchor_file is not null",
    "s_events": """select event_id as seq, case when event_id % 9 = 0 then null else concat('s', cast(user_id % 50 as string)) end as session_id,
 case when event_type = 'error' then 'clear' when event_type = 'signup' then 'end' when event_type = 'purchase' and event_id % 500 < 5 then 'reset_all' else 'read' end as op, a.anchor_file as file, e.ts as ts
 from {events} e left join (select anchor_id, min(anchor_file) as anchor_file from {decision_anchors} where anchor_id is not null group by anchor_id) a
 on a.anchor_id = cast(floor(e.event_id / 3) as bigint) + 1""",
    "g_events": "select event_id as seq, concat('s', cast(user_id % 50 as string)) as session_id, case when event_type = 'error' then 'clear' when event_type = 'signup' then 'end' when event_type = 'purchase' and event_id % 500 < 5 then 'reset_all' else 'read' end as op, concat('src/brand', cast(event_id % 25 + 1 as string), '.ts') as file from {events}",
}


def graph_relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    import re

    ship(spark)
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{d}/{m.group(1)}.parquet`", GRAPH_SQL[name]))


def graph_sql(name: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", GRAPH_SQL[name])


def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    """One row for each file, of its latest delivery: file, functions, imports, had_parse_errors, duplicate_function_names."""
    p = table(spark, d, "parsed_files")
    r = F.max_by(F.struct("functions", "imports", "had_parse_errors", "duplicate_function_names"), F.struct("indexed_at", F.xxhash64("source_text")))
    return p.where(F.col("file").isNotNull()).groupBy("file").agg(r.alias("r")).select("file", "r.*")


def present_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The functions that are there now, each (file, name) once, with the lines of the latest delivery and the least id."""
    n = table(spark, d, "nodes").where(F.col("removed_at").isNull() & F.col("file").isNotNull() & F.col("name").isNotNull())
    return (
        n.groupBy("file", "name")
        .agg(F.min("id").alias("id"), F.max(F.struct("indexed_at", "start_line", "end_line")).alias("r"))
        .select("id", "file", "name", F.lit("function").alias("kind"), "r.start_line", "r.end_line")
    )
