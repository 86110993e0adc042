"""Queries of the core; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import decisions as D
from knotwork.operators import graph as G
from knotwork.operators import orphans
from knotwork.operators import resolve as R
from knotwork.operators import serve
from knotwork.operators import sessions as S
from knotwork.operators import validate as V
from knotwork.operators.pipeline import resolve_parsed
from knotwork.plans.relations import graph_relation, parsed_files, present_nodes
from knotwork.session import cut, table
from knotwork.sources.files import extract_texts, language, scanned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _anchored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "decision_anchors"), table(spark, d, "decisions"), table(spark, d, "nodes")


@_query
def p5_found(spark, d):
    return orphans.orphan_anchors(*_anchored(spark, d)).select("anchor_id", "orphan_kind")


@_query
def p5_report(spark, d):
    return orphans.orphan_report(*_anchored(spark, d))


# -- graph of the parsed files


def _listing(spark, d) -> DataFrame:
    return table(spark, d, "parsed_files").select("file").where(F.col("file").isNotNull()).distinct()


@_query
def resolved_edges(spark, d):
    return R.call_edges(resolve_parsed(parsed_files(spark, d), _listing(spark, d)))


@_query
def call_outcomes(spark, d):
    return R.reason_counts(resolve_parsed(parsed_files(spark, d), _listing(spark, d)))


@_query
def index_totals(spark, d):
    p = parsed_files(spark, d)
    return R.totals(p, resolve_parsed(p, _listing(spark, d))).drop("reasons")


@_query
def index_summary(spark, d):
    p = parsed_files(spark, d)
    failures = table(spark, d, "pipeline_results").select(F.explode("parse_failures").alias("f")).select("f.file").distinct()
    duplicates = p.select("file", F.explode("duplicate_function_names").alias("name"))
    return serve.index_summary(R.totals(p, resolve_parsed(p, _listing(spark, d))), 0.0, failures, duplicates)


@_query
def import_resolution(spark, d):
    return R.resolve_imports(R.explode_imports(parsed_files(spark, d)), _listing(spark, d)).select("file", "ord", "local_name", "module_specifier", "resolved_file")


@_query
def function_registry(spark, d):
    return R.first_definitions(R.explode_functions(parsed_files(spark, d))).select("file", "name", "start_line", "end_line")


@_query
def duplicate_functions(spark, d):
    return parsed_files(spark, d).select("file", F.explode("duplicate_function_names").alias("name")).groupBy("file", "name").agg(F.count(F.lit(1)).alias("n_dropped"))


@_query
def scanned_files(spark, d):
    return _listing(spark, d).where(scanned(F.col("file"))).select("file", language(F.col("file")).alias("language"))


def _extracted(spark, d) -> DataFrame:
    p = table(spark, d, "parsed_files").where(F.col("file").isNotNull())
    newest = p.groupBy("file").agg(F.max_by("source_text", F.struct("indexed_at", F.xxhash64("source_text"))).alias("source_text"))
    return extract_texts(newest)


@_query
def extracted_functions(spark, d):
    return R.explode_functions(_extracted(spark, d)).select("file", "name", "start_line", "end_line", F.size("calls").alias("n_calls"))


@_query
def extracted_imports(spark, d):
    return R.explode_imports(_extracted(spark, d))


@_query
def extracted_edges(spark, d):
    return R.call_edges(resolve_parsed(_extracted(spark, d), _listing(spark, d)))


# -- graph over the star schema: every kind of outcome occurs there


def _g(spark, d, name):
    return graph_relation(spark, d, name)


def _g_nodes(spark, d) -> DataFrame:
    return R.first_definitions(_g(spark, d, "g_node_inputs")).drop("ord")


def _g_resolved(spark, d) -> DataFrame:
    return R.resolve_calls(_g(spark, d, "g_calls"), _g(spark, d, "g_imports"), _g_nodes(spark, d))


@_query
def g_first_definitions(spark, d):
    return _g_nodes(spark, d)


@_query
def g_duplicate_definitions(spark, d):
    return R.duplicate_definitions(_g(spark, d, "g_node_inputs"))


@_query
def g_call_outcomes(spark, d):
    return R.reason_counts(_g_resolved(spark, d))


@_query
def g_resolved_edges(spark, d):
    return R.call_edges(_g_resolved(spark, d))


@_query
def g_upserted_nodes(spark, d):
    """Half of the inputs are there already, then all are upserted."""
    inputs = _g(spark, d, "g_node_inputs")
    empty = spark.createDataFrame([], "id long, file string, name string, kind string, start_line int, end_line int")
    before, _ = G.upsert_nodes(empty, inputs.where("ord % 2 = 0"))
    after, ids = G.upsert_nodes(before, inputs)
    n = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n_inputs"))
    return after.join(n, "id").select("file", "name", "start_line", "end_line", "n_inputs")


@_query
def g_inserted_edges(spark, d):
    """Edges of the resolved calls inserted twice over; the ends as natural keys."""
    nodes = _g_nodes(spark, d).withColumn("id", F.xxhash64("file", "name"))
    sites = _g_resolved(spark, d).where(F.col("reason").isNull()).select(F.xxhash64("file", "caller").alias("source_id"), F.xxhash64("target_file", "target_name").alias("target_id"), F.lit("calls").alias("kind"))
    empty = spark.createDataFrame([], "source_id long, target_id long, kind string, count long")
    edges = G.cascade_edges(G.insert_edges(G.insert_edges(empty, sites), sites), nodes)
    a = nodes.select(F.col("id").alias("source_id"), F.col("file").alias("source_file"), F.col("name").alias("source_name"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("file").alias("target_file"), F.col("name").alias("target_name"))
    return edges.join(a, "source_id").join(b, "target_id").select("source_file", "source_name", "target_file", "target_name", "count")


@_query
def g_innermost(spark, d):
    probes = _g(spark, d, "g_events").select("seq", "file", (F.col("seq") % 450 + 1).cast("int").alias("line"))
    return G.innermost(_g_nodes(spark, d), probes).select("seq", "file", "line", "start_line", "end_line", "name")


# -- look-ups


@_query
def node_by_id(spark, d):
    return G.node_by_id(present_nodes(spark, d), 2)


@_query
def nodes_by_name(spark, d):
    n = present_nodes(spark, d)
    return G.nodes_by_name(n, n.agg(F.min("name")).first()[0]).select("id", "file", "name", "start_line", "end_line")


@_query
def nodes_by_file(spark, d):
    n = present_nodes(spark, d)
    return G.nodes_by_file(n, n.agg(F.min("file")).first()[0]).select("id", "file", "name", "start_line", "end_line")


def _g_edges(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes with an id, the place of the name in the order of files; edges by ids)."""
    inputs = _g(spark, d, "g_node_inputs").withColumn("ord", F.struct("file", "name"))
    nodes, _ = G.upsert_nodes(spark.createDataFrame([], "id long, file string, name string, kind string, start_line int, end_line int"), inputs)
    nodes = cut(nodes)
    a = nodes.select(F.col("id").alias("source_id"), "file", F.col("name").alias("caller"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("file").alias("target_file"), F.col("name").alias("target_name"))
    sites = _g_resolved(spark, d).where(F.col("reason").isNull()).join(a, ["file", "caller"]).join(b, ["target_file", "target_name"])
    return nodes, G.insert_edges(spark.createDataFrame([], "source_id long, target_id long, kind string, count long"), sites.select("source_id", "target_id", F.lit("calls").alias("kind")))


@_query
def edges_from_node(spark, d):
    return G.edges_from(_g_edges(spark, d)[1], 3)


@_query
def edges_to_node(spark, d):
    return G.edges_to(_g_edges(spark, d)[1], 11)


@_query
def edge_degrees(spark, d):
    """How many edges every function has, by its id."""
    nodes, edges = _g_edges(spark, d)
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_targets"), F.sum("count").alias("n_calls"))
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_sources"))
    return nodes.select("id", "file", "name").join(out, "id", "left").join(into, "id", "left").select("id", "file", "name", "n_targets", "n_calls", "n_sources")


@_query
def table_counts(spark, d):
    return G.counts(present_nodes(spark, d), R.call_edges(resolve_parsed(parsed_files(spark, d), _listing(spark, d))))


# -- decisions


def _store(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        D.distinct_decisions(table(spark, d, "decisions")),
        D.distinct_anchors(table(spark, d, "decision_anchors")),
        D.distinct_keywords(table(spark, d, "decision_keywords")),
    )


@_query
def decisions_for_function(spark, d):
    decisions, anchors, _ = _store(spark, d)
    return D.decisions_for_function(decisions, anchors, present_nodes(spark, d).select("file", "name")).select("file", "name", "decision_id")


@_query
def decisions_for_file(spark, d):
    decisions, anchors, _ = _store(spark, d)
    return D.decisions_for_file(decisions, anchors, _listing(spark, d)).select("file", "decision_id", "created_at", "session_id")


@_query
def decisions_by_keyword(spark, d):
    decisions, _, keywords = _store(spark, d)
    return D.newest_first(D.decisions_by_keyword(decisions, keywords, "ordering")).select("id", "decision", "session_id", "created_at")


@_query
def anchor_liveness(spark, d):
    return D.anchors_with_liveness(_store(spark, d)[1], present_nodes(spark, d))


@_query
def live_anchor_count(spark, d):
    return D.live_counts(D.anchors_with_liveness(_store(spark, d)[1], present_nodes(spark, d)))


@_query
def keywords_of_decisions(spark, d):
    return D.keywords_of(_store(spark, d)[2]).select("decision_id", F.array_join("keywords", "|").alias("keywords"))


@_query
def anchors_of_decisions(spark, d):
    a = D.anchors_of(D.anchors_with_liveness(_store(spark, d)[1], present_nodes(spark, d)))
    line = F.transform("anchors", lambda x: serve.anchor_line(x["kind"], x["file"], x["name"], x["live"]))
    return a.select("decision_id", F.array_join(line, "|").alias("anchors"))


def _ids(spark, d) -> DataFrame:
    """Every decision whose id is divisible by 20, as a list to look up."""
    return table(spark, d, "decisions").where("id % 20 = 0").select("id").distinct()


@_query
def keywords_of_listed(spark, d):
    return D.keywords_of(_store(spark, d)[2], _ids(spark, d)).select("decision_id", F.array_join("keywords", "|").alias("keywords"))


@_query
def anchors_of_listed(spark, d):
    a = D.anchors_of(D.anchors_with_liveness(_store(spark, d)[1], present_nodes(spark, d)), _ids(spark, d))
    return a.select("decision_id", F.size("anchors").alias("n_anchors"))


@_query
def live_of_listed(spark, d):
    return D.live_counts(D.anchors_with_liveness(_store(spark, d)[1], present_nodes(spark, d)), _ids(spark, d))


@_query
def vocabulary_top(spark, d):
    return D.vocabulary(_store(spark, d)[2], 100)


@_query
def kept_children(spark, d):
    decisions, anchors, keywords = _store(spark, d)
    kept = decisions.where(F.col("session_id").isNotNull())
    a = G.cascade_children(anchors, kept).agg(F.count(F.lit(1)).alias("n_anchors"))
    return a.crossJoin(G.cascade_children(keywords, kept).agg(F.count(F.lit(1)).alias("n_keywords")))


# -- sessions and rendering


def _s(spark, d) -> tuple[DataFrame, DataFrame]:
    """Events of sessions that read anchored files, and which decisions are on which file."""
    return _g(spark, d, "s_events"), _g(spark, d, "s_pairs")


@_query
def session_reads(spark, d):
    return S.read_summary(*_s(spark, d)).select("seq", "session_id", "total", "new_cnt")


@_query
def session_new_decisions(spark, d):
    return S.new_decisions(*_s(spark, d)).select("seq", "session_id", "decision_id")


@_query
def session_read_decisions(spark, d):
    return S.read_decisions(*_s(spark, d)).select("seq", "session_id", "decision_id", "is_new")


@_query
def session_state(spark, d):
    return S.final_state(*_s(spark, d))


def _states(spark, d) -> DataFrame:
    events, pairs = _s(spark, d)
    return S.session_states(events, pairs, "ts")


@_query
def session_states(spark, d):
    """The stored states after all events."""
    return _states(spark, d).select("session_id", "modified_at", F.array_join("shown_decision_ids", ",").alias("shown"))


@_query
def session_shown(spark, d):
    """What the default session has been shown."""
    return S.read_shown(_states(spark, d), None)


@_query
def session_written(spark, d):
    """The states after one of them is cleared by a write and one that wasn't there is written."""
    now = datetime(2030, 1, 1)
    written = spark.createDataFrame([("s1", []), ("new", [1, 2])], "session_id string, shown_decision_ids array<long>")
    return S.write_shown(_states(spark, d), written, now).select("session_id", "modified_at", F.size("shown_decision_ids").alias("n_shown"))


@_query
def session_wiped(spark, d):
    return S.wiped(_states(spark, d), datetime(2030, 1, 1)).select("session_id", F.size("shown_decision_ids").alias("n_shown"))


@_query
def session_kept(spark, d):
    """The states that are left when session s2 ends half a day after the last write, of those kept for a day."""
    states = _states(spark, d)
    now = states.agg((F.max("modified_at") + F.expr("interval 12 hours")).alias("t")).first()["t"] or datetime(2030, 1, 1)
    return S.collected_sessions(states, spark.createDataFrame([("s2",)], "session_id string"), now, 1).select("session_id")


@_query
def reset_message(spark, d):
    return S.reset_message(_states(spark, d))


@_query
def read_texts(spark, d):
    events, pairs = _s(spark, d)
    return serve.render_reads(*S.served(events, pairs), *_store(spark, d))


@_query
def hook_replies(spark, d):
    return read_texts(spark, d).select("seq", serve.envelope(F.col("text")).alias("reply"))


@_query
def injected(spark, d):
    """Replies to raw events, one JSON object each: half of the paths are absolute, some lie outside, some events are broken."""
    path = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("/other/"), "file")).when(F.col("seq") % 2 == 0, F.concat(F.lit("/work/"), "file")).otherwise(F.col("file"))
    whole = F.to_json(F.struct(F.struct(path.alias("file_path")).alias("tool_input"), "session_id", F.lit("/work").alias("cwd")))
    raw = _s(spark, d)[0].select("seq", "op", F.when((F.col("op") == "read") & (F.col("seq") % 13 == 0), F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    return serve.inject(raw, *_store(spark, d)).select("seq", "session_id", "file", "reply")


@_query
def keyword_listing(spark, d):
    decisions, anchors, keywords = _store(spark, d)
    return serve.keyword_listing(decisions, keywords, D.anchors_with_liveness(anchors, present_nodes(spark, d)), "ordering")


@_query
def keyword_replies(spark, d):
    """Replies to sound and faulty calls."""
    decisions, anchors, keywords = _store(spark, d)
    live = D.anchors_with_liveness(anchors, present_nodes(spark, d))
    calls = (None, "[1]", "{}", '{"keyword": ""}', '{"keyword": 3}', '{"keyword": "no such keyword"}', '{"keyword": "retry"}')
    out = None
    for n, raw in enumerate(calls):
        r = serve.keyword_reply(raw, decisions, keywords, live).select(F.lit(n).alias("call"), "ok", "text")
        out = r if out is None else out.unionByName(r)
    return out


@_query
def keyword_help(spark, d):
    return serve.keyword_help(_store(spark, d)[2])


# -- validation


def _raw_batches(spark, d) -> DataFrame:
    """One batch of JSON for each decision, as stored: faults and all."""
    decisions, anchors, keywords = _store(spark, d)
    a = anchors.groupBy("decision_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("anchor_kind").alias("kind"), F.col("anchor_file").alias("file"), F.when(F.col("anchor_kind") == "function", F.col("anchor_name")).alias("name")))).alias("anchors")
    )
    k = keywords.groupBy("decision_id").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    rows = decisions.select(F.col("id").alias("decision_id"), "decision").join(a, "decision_id", "left").join(k, "decision_id", "left")
    return rows.select("decision_id", F.to_json(F.struct(F.array(F.struct("decision", "anchors", "keywords")).alias("decisions"))).alias("raw"))


@_query
def record_faults(spark, d):
    return V.batch_faults(_raw_batches(spark, d), "decision_id", "raw")


@_query
def record_messages(spark, d):
    return V.fault_messages(record_faults(spark, d), "decision_id")
