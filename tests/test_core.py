import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions.paths import uniform_path
from knotwork.functions.text import uniform_keyword
from knotwork.operators import decisions as D
from knotwork.operators import graph as G
from knotwork.operators import orphans
from knotwork.operators import resolve as R
from knotwork.operators import serve, validate
from knotwork.operators import sessions as S
from knotwork.operators.pipeline import index_tree
from knotwork.operators.store import Refused, Store

NODE = "id long, file string, name string, kind string, start_line int, end_line int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# -- paths and keywords


def test_uniform_path(spark):
    given = ["a/b.ts", " a/b.ts\t", "a\\b.ts", "./a//./b.ts", "x/../a/b.ts", "a/x/y/../../b.ts", ".\\a\\b.ts", " a/b.ts", "../a/b.ts", "", None, "A/b.ts", "a/..b/c"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string").orderBy("i").select(uniform_path(F.col("p"))).collect()]
    assert got == ["a/b.ts"] * 8 + ["../a/b.ts", "", None, "A/b.ts", "a/..b/c"]


def test_uniform_keyword(spark):
    given = [" Retry\t", "　RETRY ", "re try", "\n", None]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string").orderBy("i").select(uniform_keyword(F.col("p"))).collect()]
    assert got == ["retry", "retry", "re try", "", None]


# -- imports and calls


def test_import_candidates(spark):
    files = ["src/a.ts", "src/d.ts", "src/b/index.ts", "src/b/c.ts", "src/b/mod.mjs", "src/d/index.js", "data.json"]
    listing = spark.createDataFrame([(f,) for f in files], "file string")
    wanted = [("./d", "src/d.ts"), ("./b", "src/b/index.ts"), ("./b/c", "src/b/c.ts"), ("./b/mod.mjs", "src/b/mod.mjs"), ("./none", None), ("react", None), ("../data.json", "data.json"), ("./b/../a", "src/a.ts"), ("../../x", None), ("/src/a", None)]
    imports = spark.createDataFrame([("src/a.ts", i, "x", s) for i, (s, _) in enumerate(wanted)], "file string, ord int, local_name string, module_specifier string")
    got = R.resolve_imports(imports, listing)
    assert [r[0] for r in got.orderBy("ord").select("resolved_file").collect()] == [w for _, w in wanted]


def test_call_outcomes(spark):
    nodes = spark.createDataFrame([("b.ts", "foo"), ("a.ts", "local"), ("a.ts", "foo")], "file string, name string")
    imports = spark.createDataFrame(
        [
            ("a.ts", 0, "foo", "foo", False, False, "b.ts"), ("a.ts", 1, "foo", "other", False, False, None), ("a.ts", 2, "bar", "foo", False, False, "b.ts"),
            ("a.ts", 3, "def", "default", True, False, "b.ts"), ("a.ts", 4, "ns", "*", False, True, "b.ts"), ("a.ts", 5, "ext", "ext", False, False, None),
            ("a.ts", 6, "miss", "gone", False, False, "b.ts"), ("a.ts", 7, "extdef", "default", True, False, None), ("a.ts", 8, "local", "gone", False, False, "b.ts"),
        ],
        "file string, ord int, local_name string, imported_name string, is_default boolean, is_namespace boolean, resolved_file string",
    )
    want = {"foo": ("b.ts", "foo", None), "bar": ("b.ts", "foo", None), "a.b": (None, None, "member_chain"), "def": (None, None, "default_import"), "ns": (None, None, "namespace_import"), "ext": (None, None, "external"), "miss": (None, None, "barrel_miss"), "extdef": (None, None, "external"), "local": (None, None, "barrel_miss"), "none": (None, None, "unknown_bare")}
    calls = spark.createDataFrame([("a.ts", "caller", c) for c in want] + [("b.ts", "k", "foo"), ("b.ts", "k", "foo")], "file string, caller string, callee string")
    got = R.resolve_calls(calls, imports, nodes)
    assert {r["callee"]: (r["target_file"], r["target_name"], r["reason"]) for r in got.where("file = 'a.ts'").collect()} == want
    assert rows(R.call_edges(got).where("source_file = 'b.ts'"), "target_name", "count") == [("foo", 2)]
    counts = dict(rows(R.reason_counts(got), "reason", "n"))
    assert counts == {"member_chain": 1, "external": 2, "default_import": 1, "namespace_import": 1, "barrel_miss": 2, "unknown_bare": 1}
    assert dict(rows(R.reason_counts(got.where("false")), "reason", "n")) == dict.fromkeys(counts, 0)


# -- graph


def test_upsert_keeps_ids_and_takes_the_last_lines(spark):
    schema = "ord long, file string, name string, kind string, start_line int, end_line int"
    empty = spark.createDataFrame([], NODE)
    first = spark.createDataFrame([(0, "a", "f", "function", 1, 2), (1, "a", "g", "function", 3, 4), (2, "b", "f", "function", 5, 6)], schema)
    nodes, ids = G.upsert_nodes(empty, first)
    assert rows(ids, "ord", "id") == [(0, 1), (1, 2), (2, 3)]
    again = spark.createDataFrame([(0, "a", "g", "function", 13, 14), (1, "c", "h", "function", 1, 1), (2, "a", "g", "function", 23, 24)], schema)
    after, ids2 = G.upsert_nodes(nodes, again)
    assert rows(ids2, "ord", "id") == [(0, 2), (1, 4), (2, 2)]
    assert rows(after, "id", "start_line") == [(1, 1), (2, 23), (3, 5), (4, 1)]
    assert G.upsert_nodes(empty, first.where("false"))[0].count() == 0


def test_edges_count_and_cascade(spark):
    nodes = spark.createDataFrame([(1, "a", "f", "function", 1, 2), (2, "a", "g", "function", 1, 2)], NODE)
    one = spark.createDataFrame([(1, 2, "calls")], "source_id long, target_id long, kind string")
    edges = spark.createDataFrame([], "source_id long, target_id long, kind string, count long")
    for batch in (one, one, one, one.union(one)):
        edges = G.insert_edges(edges, batch)
    assert rows(edges, "count") == [(5,)]
    assert G.dangling_edges(edges, nodes).count() == 0
    assert G.dangling_edges(edges, nodes.where("id = 1")).count() == 1
    assert G.cascade_edges(edges, nodes.where("id = 1")).count() == 0
    assert G.edges_from(edges, 1).count() == 1 and G.edges_to(edges, 1).count() == 0


def test_innermost(spark):
    nodes = spark.createDataFrame([(1, "a", "outer", "function", 10, 50), (2, "a", "inner", "function", 20, 30), (3, "b", "flat", "function", 10, 20)], NODE)
    probes = spark.createDataFrame([("a", 25), ("a", 15), ("b", 15), ("b", 100), ("a", 20)], "file string, line int")
    assert rows(G.innermost(nodes, probes), "file", "line", "name") == [("a", 15, "outer"), ("a", 20, "inner"), ("a", 25, "inner"), ("b", 15, "flat")]


# -- decisions


@pytest.fixture(scope="module")
def knowledge(spark):
    nodes = spark.createDataFrame([("f.ts", "live")], "file string, name string")
    decisions = spark.createDataFrame([(1, "one", None, "2025-01-01"), (2, "two", "s", "2025-01-02"), (3, "three", "s", "2025-01-02")], "id long, decision string, session_id string, created_at string")
    anchors = spark.createDataFrame([(1, "function", "f.ts", "live"), (1, "function", "f.ts", "gone"), (2, "file", "f.ts", ""), (3, "file", "dead.ts", "")], "decision_id long, anchor_kind string, anchor_file string, anchor_name string")
    keywords = spark.createDataFrame([(1, "retry"), (2, "retry"), (2, "a-b"), (3, "retry"), (3, "a-b"), (3, "z")], "decision_id long, keyword string")
    return nodes, decisions, anchors, keywords


def test_lookups(spark, knowledge):
    nodes, decisions, anchors, keywords = knowledge
    wanted = spark.createDataFrame([("f.ts", "live"), ("f.ts", "anything"), ("dead.ts", "x")], "file string, name string")
    assert rows(D.decisions_for_function(decisions, anchors, wanted), "file", "name", "decision_id") == [("dead.ts", "x", 3), ("f.ts", "anything", 2), ("f.ts", "live", 1), ("f.ts", "live", 2)]
    assert rows(D.decisions_for_file(decisions, anchors, wanted.select("file").distinct()), "file", "decision_id") == [("dead.ts", 3), ("f.ts", 1), ("f.ts", 2)]
    assert [r["id"] for r in D.newest_first(D.decisions_by_keyword(decisions, keywords, "retry")).collect()] == [2, 3, 1]
    live = D.anchors_with_liveness(anchors, nodes)
    assert rows(live, "decision_id", "anchor_name", "live") == [(1, "gone", False), (1, "live", True), (2, "", True), (3, "", False)]
    assert rows(D.live_counts(live), "total", "live") == [(4, 2)]
    assert rows(D.live_counts(live, spark.createDataFrame([], "id long")), "total", "live") == [(0, 0)]
    assert [r["keyword"] for r in D.vocabulary(keywords).collect()] == ["retry", "a-b", "z"]
    assert [r["keyword"] for r in D.vocabulary(keywords, 1).collect()] == ["retry"]
    text = serve.keyword_listing(decisions, keywords, live, "retry").first()["text"]
    assert text.startswith('3 decisions tagged "retry":\n\n#2 [a-b, retry] two\n  anchors:\n    file f.ts (live)\n\n#3')
    assert text.endswith("    function f.ts::gone (dead)\n    function f.ts::live (live)")
    assert serve.keyword_listing(decisions, keywords, live, "no").first()["text"] == '0 decisions tagged "no"'
    assert serve.keyword_help(keywords, "Intro").first()["text"] == "Intro\n\nEXISTING KEYWORDS (frequency desc):\nretry, a-b, z"
    assert serve.keyword_help(keywords.where("false"), "Intro").first()["text"] == "Intro"


def test_keyword_listing_is_cut_at_fifty(spark, knowledge):
    nodes, *_ = knowledge
    decisions = spark.createDataFrame([(i, f"d{i}", None, "t") for i in range(60)], "id long, decision string, session_id string, created_at string")
    keywords = spark.createDataFrame([(i, "k") for i in range(60)], "decision_id long, keyword string")
    anchors = spark.createDataFrame([(i, "file", "f.ts", "") for i in range(60)], "decision_id long, anchor_kind string, anchor_file string, anchor_name string")
    text = serve.keyword_listing(decisions, keywords, D.anchors_with_liveness(anchors, nodes), "k").first()["text"]
    assert text.startswith("60 decisions") and text.count("\n#") == 50 and text.endswith("(50 of 60 shown; refine the keyword)")


# -- validation


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ["arguments must be an object"]), ("[]", ["arguments must be an object"]), ("{", ["arguments must be an object"]), ("{}", ["decisions must be an array"]), ('{"decisions": []}', ["decisions must be a non-empty array"]),
        ('{"decisions": [1]}', ["decisions[0] must be an object"]),
        ('{"decisions": [{}]}', ["decisions[0].decision must be a non-empty string", "decisions[0].anchors must be an array", "decisions[0].keywords must be an array"]),
        ('{"decisions": [{"decision": "", "anchors": [], "keywords": []}]}', ["decisions[0].decision must be a non-empty string", "decisions[0].anchors must be non-empty", "decisions[0].keywords must be non-empty"]),
        ('{"decisions": [{"decision": "d", "anchors": [{"kind": "x", "file": ""}, {"kind": "function", "file": "f"}, {"kind": "file", "file": "f", "name": null}, 3], "keywords": ["ok", "ok", "Bad", 4]}]}',
         ["decisions[0].anchors[0].kind must be 'function' or 'file'", "decisions[0].anchors[0].file must be a non-empty string", "decisions[0].anchors[1].name required when kind='function'", "decisions[0].anchors[2] must not include 'name' when kind='file'", "decisions[0].anchors[3] must be an object",
          'decisions[0].keywords[1] duplicate "ok"', 'decisions[0].keywords[2] "Bad" must match ^[a-z][a-z0-9-]{0,38}[a-z0-9]$', "decisions[0].keywords[3] must be a string"]),
        ('{"decisions": [{"decision": "d", "anchors": [{"kind": "file", "file": "f"}], "keywords": ["abc\\n"]}]}', ['decisions[0].keywords[0] "abc\n" must match ^[a-z][a-z0-9-]{0,38}[a-z0-9]$']),
        ('{"decisions": [{"decision": "d", "anchors": [{"kind": "file", "file": "f"}], "keywords": ["ab"]}]}', []),
    ],
)
def test_faults(raw, want):
    assert validate.faults(raw) == want


def test_fault_messages_are_cut_at_fifty(spark):
    raw = '{"decisions": [' + ",".join(["1"] * 60) + "]}"
    batch = spark.createDataFrame([(1, raw)], "k int, raw string")
    message = validate.fault_messages(validate.batch_faults(batch, "k", "raw"), "k").first()["message"]
    assert len(message.split("\n")) == 51 and message.endswith("... and 10 more")


# -- sessions


def simulate(events, pairs):
    shown, out = {}, []
    for seq, session, op, file in sorted(events):
        s = shown.setdefault(session, set())
        if op in ("clear", "end"):
            s.clear()
        elif op == "reset_all":
            for x in shown.values():
                x.clear()
        else:
            for d, f in pairs:
                if f == file:
                    out.append((seq, session, d, d not in s))
            s.update(d for d, f in pairs if f == file)
    return sorted(out), shown


@pytest.fixture(scope="module")
def event_log():
    r = random.Random(3)
    pairs = sorted({(r.randrange(12), f"f{r.randrange(6)}") for _ in range(30)})
    events = [(i, r.choice("abc"), r.choices(["read", "clear", "end", "reset_all"], [20, 1, 1, 1])[0], f"f{r.randrange(7)}") for i in range(400)]
    return events, pairs


def test_shown_once(spark, event_log):
    events, pairs = event_log
    e = spark.createDataFrame(events, "seq long, session_id string, op string, file string")
    p = spark.createDataFrame(pairs, "decision_id long, file string")
    want, state = simulate(events, pairs)
    assert rows(S.read_decisions(e, p), "seq", "session_id", "decision_id", "is_new") == sorted(want, key=repr)
    assert rows(S.new_decisions(e, p), "seq", "session_id", "decision_id") == sorted((x[:3] for x in want if x[3]), key=repr)
    counts = {}
    for seq, _, _, new in want:
        a, b = counts.get(seq, (0, 0))
        counts[seq] = (a + 1, b + new)
    assert {r["seq"]: (r["total"], r["new_cnt"]) for r in S.read_summary(e, p).collect()} == counts
    assert rows(S.final_state(e, p), "session_id", "decision_id") == sorted(((s, d) for s, ds in state.items() for d in ds), key=repr)
    assert S.read_decisions(e.where("false"), p).count() == 0


@pytest.mark.parametrize("share, buckets", [(0.01, 1024), (0.0001, 7)])
def test_sessions_meet_all_decisions(spark, tmp_path, monkeypatch, share, buckets):
    """Null sessions, files and keys, repeated rows, hot files, columns of clashing names."""
    from knotwork.plans.queries import QUERIES
    from knotwork.plans.relations import graph_relation

    monkeypatch.setattr(S, "HEAVY_SHARE", share)
    monkeypatch.setattr(S, "BUCKETS", buckets)
    r = random.Random(5)
    anchors = [(i + 1, r.randrange(40), r.choice(["file", "function"]), "hot.ts" if i % 3 == 0 else f"f{r.randrange(9)}.ts", r.choice(["", "g", None]), "x") for i in range(120)]
    tables = {
        "decision_anchors": (anchors + anchors[:9] + [(None, 1, "file", None, "", "x"), (500, None, "file", "f1.ts", "", "x")], "anchor_id long, decision_id long, anchor_kind string, anchor_file string, anchor_name string, part string"),
        "decisions": ([(i, f"text {i}" if i % 7 else None, None, f"2025-01-{i % 28 + 1:02d}") for i in range(40)], "id long, decision string, session_id string, created_at string"),
        "decision_keywords": ([(i, f"k{i % 3}") for i in range(40)], "decision_id long, keyword string"),
        "events": ([(e, r.randrange(4), r.choices(["view", "error", "signup", "purchase"], [20, 1, 1, 1])[0], dt.datetime(2025, 1, 1) + dt.timedelta(minutes=e)) for e in range(300)], "event_id long, user_id long, event_type string, ts timestamp_ntz"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    pairs = sorted({(x[1], x[3]) for x in tables["decision_anchors"][0] if x[1] is not None and x[3] is not None})
    events = [(x["seq"], x["session_id"] or "_default", x["op"], x["file"]) for x in graph_relation(spark, d, "s_events").orderBy("seq").collect()]
    want, state = simulate(events, pairs)
    counts = {}
    for seq, session, _, new in want:
        a, b = counts.get((seq, session), (0, 0))
        counts[seq, session] = (a + 1, b + new)
    assert rows(QUERIES["session_reads"](spark, d), "seq", "session_id", "total", "new_cnt") == sorted(((*k, *v) for k, v in counts.items()), key=repr)
    assert rows(QUERIES["session_new_decisions"](spark, d), "seq", "session_id", "decision_id") == sorted((x[:3] for x in want if x[3]), key=repr)
    assert rows(QUERIES["session_read_decisions"](spark, d), "seq", "session_id", "decision_id", "is_new") == sorted(want, key=repr)
    assert rows(QUERIES["session_state"](spark, d), "session_id", "decision_id") == sorted(((s, x) for s, xs in state.items() for x in xs), key=repr)
    texts = {x["seq"]: x["text"] for x in QUERIES["read_texts"](spark, d).collect()}
    assert set(texts) == {seq for seq, _ in counts} and all(f"] {n} decisions on " in texts[seq] for (seq, _), (n, _) in counts.items())
    assert QUERIES["hook_replies"](spark, d).count() == len(texts)
    plan = QUERIES["session_reads"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stored_states(spark):
    """A read writes a state, clear empties it, end removes it, a reset of all empties those there are; the default session too."""
    t = dt.datetime(2025, 1, 1)
    log = [("a", "read", "f"), ("b", "read", "f"), ("a", "clear", None), (None, "read", "f"), ("b", "end", None), ("c", "read", "unknown"), ("d", "clear", None), (None, "reset_all", None), ("e", "read", "f"), (None, "read", "g")]
    e = spark.createDataFrame([(i, s, op, f, t + dt.timedelta(hours=i)) for i, (s, op, f) in enumerate(log)] + [(None, "z", "read", "f", t)], "seq long, session_id string, op string, file string, modified_at timestamp")
    p = spark.createDataFrame([(2, "f"), (1, "f"), (3, "g"), (4, None)], "decision_id long, file string")
    states = S.session_states(e, p).cache()
    at = lambda h: t + dt.timedelta(hours=h)
    assert rows(states, "session_id", "modified_at", "shown_decision_ids") == sorted([("a", at(7), []), ("_default", at(9), [3]), ("d", at(7), []), ("e", at(8), [1, 2])], key=repr)
    assert rows(S.read_shown(states, None), "decision_id") == [(3,)] and S.read_shown(states, "no").count() == 0
    again = S.write_shown(states, spark.createDataFrame([("e", [7]), (None, [])], "session_id string, shown_decision_ids array<long>"), at(20))
    assert {r["session_id"]: r["shown_decision_ids"] for r in again.collect()} == {"a": [], "d": [], "e": [7], "_default": []}
    assert {tuple(r["shown_decision_ids"]) for r in S.wiped(states, at(20)).collect()} == {()}
    assert S.reset_message(states).first()["text"] == "decision cache reset (4 session files wiped)"
    assert S.reset_message(states.where("session_id = 'a'")).first()["text"] == "decision cache reset (1 session file wiped)"
    assert S.reset_message(states.where("false")).first()["text"] == "decision cache reset (0 session files wiped)"
    assert S.session_states(e.where("false"), p).count() == 0
    assert S.state_path("/work/", None) == "/work/sessions/session_id=_default"


def test_keyword_replies_and_summary_lines(spark, knowledge):
    nodes, decisions, anchors, keywords = knowledge
    live = D.anchors_with_liveness(anchors, nodes)
    reply = lambda raw: tuple(serve.keyword_reply(raw, decisions, keywords, live).first())
    assert reply(None) == reply("[]") == reply("{") == (False, "arguments must be an object")
    assert reply("{}") == reply('{"keyword": ""}') == reply('{"keyword": 1}') == (False, "keyword must be a non-empty string")
    assert reply('{"keyword": "none of these"}') == (True, '0 decisions tagged "none of these"')
    totals = spark.createDataFrame([(1, 2, 0, 0, 0, {}, 0)], "files long, functions long, calls long, resolved long, unresolved long, reasons map<string,long>, files_with_parse_errors long")
    failures = spark.createDataFrame([(f"f{i}",) for i in range(5)], "file string")
    dup = spark.createDataFrame([("a", "g"), ("a", "f")], "file string, name string")
    assert serve.index_summary(totals, 0.0, failures, dup).first()["text"].split("\n")[2:] == ["  0 calls", "  5 parse failures: f0, f1, f2", "  2 duplicate function names dropped: a::f, a::g"]
    assert serve.index_summary(totals, 0.0, failures.where("false"), dup.where("false")).first()["text"].split("\n")[2:] == ["  0 calls"]


def test_shown_once_on_a_stream(spark, event_log, tmp_path):
    from knotwork.streaming.sessions import shown_once

    events, pairs = event_log
    epoch, told = 0, []
    for seq, session, op, file in events:
        epoch += op == "reset_all"
        told.append((seq, session, op, file, epoch))
    schema = "seq long, session_id string, op string, file string, epoch long"
    for i in range(0, 400, 100):
        spark.createDataFrame(told[i : i + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    p = spark.createDataFrame(pairs, "decision_id long, file string")
    q = shown_once(stream, p, forget=False).writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    assert rows(spark.table("shown"), "seq", "session_id", "decision_id", "is_new") == sorted(simulate(events, pairs)[0], key=repr)


def test_state_collection(spark):
    now = dt.datetime(2025, 1, 10)
    states = spark.createDataFrame([("named", now), ("old", now - dt.timedelta(days=8)), ("week", now - dt.timedelta(days=7)), ("fresh", now)], "session_id string, modified_at timestamp")
    ended = spark.createDataFrame([("named",)], "session_id string")
    assert rows(S.collected_sessions(states, ended, now), "session_id") == [("fresh",), ("week",)]


def counted(shown):
    return shown.groupBy("seq", "session_id", "file").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_new").alias("new_cnt"))


def test_render(spark):
    shown = spark.createDataFrame([(1, "s", "a.ts", 1, True), (1, "s", "a.ts", 2, True), (1, "s", "a.ts", 3, False), (2, "s", "a.ts", 1, False)], "seq long, session_id string, file string, decision_id long, is_new boolean")
    decisions = spark.createDataFrame([(1, "whole", "2025"), (2, "parts", "2024"), (3, "seen", "2023")], "id long, decision string, created_at string")
    anchors = spark.createDataFrame([(1, "file", "a.ts", ""), (1, "function", "a.ts", "g"), (2, "function", "a.ts", "g"), (2, "function", "a.ts", "f"), (3, "file", "a.ts", "")], "decision_id long, anchor_kind string, anchor_file string, anchor_name string")
    keywords = spark.createDataFrame([(1, "k"), (2, "b"), (2, "a")], "decision_id long, keyword string")
    got = {r["seq"]: r["text"] for r in serve.render_reads(counted(shown), shown.where("is_new"), decisions, anchors, keywords).collect()}
    assert got[1].split("\n") == ["[decisions] 3 decisions on a.ts (2 new, 1 shown earlier)", "", "NEW:", "file-level:", "  [k] whole", "fn f():", "  [a, b] parts", "fn g():", "  [a, b] parts", "", "(1 decision on this file already shown earlier this session.", "If your context was compacted, reset the decision cache.)"]
    assert got[2].startswith("[decisions] 1 decisions on a.ts shown earlier this session.\n")
    many = spark.createDataFrame([(9, "s", "b.ts", i, True) for i in range(60)], "seq long, session_id string, file string, decision_id long, is_new boolean")
    long = spark.createDataFrame([(i, "x" * 300, "2025") for i in range(60)], "id long, decision string, created_at string")
    on = spark.createDataFrame([(i, "file", "b.ts", "") for i in range(60)], "decision_id long, anchor_kind string, anchor_file string, anchor_name string")
    text = serve.render_reads(counted(many), many, long, on, keywords.where("false")).first()["text"]
    assert len(text) <= 8200 and "additional lines truncated; 60 decisions total" in text


def test_hook_events(spark):
    raw = spark.createDataFrame(
        [(1, '{"tool_input": {"file_path": "/r/a.ts"}, "cwd": "/r", "session_id": "s"}'), (2, "{broken"), (3, '{"tool_input": {}, "cwd": "/r"}'), (4, '{"tool_input": {"file_path": "/other/a.ts"}, "cwd": "/r"}'), (5, '{"tool_input": {"file_path": "a.ts"}, "cwd": "/r"}'), (6, '{"tool_input": {"file_path": "../a.ts"}, "cwd": "/r"}'), (7, '{"tool_input": {"file_path": "a.ts"}}')],
        "seq long, value string",
    )
    assert rows(serve.hook_events(raw), "seq", "session_id", "file") == [(1, "s", "a.ts"), (5, "_default", "a.ts")]


# -- orphans


def brute_orphans(anchors, decisions, nodes):
    import posixpath

    when = {}
    for i, t in decisions:
        if i is not None and t is not None:
            when[i] = min(when.get(i, t), t)
    kept = {}
    for a in anchors:
        if a[0] is not None and a[2] in ("function", "file"):
            kept.setdefault(a[0], a)
    out = []
    for aid, did, kind, file, name in kept.values():
        path = None if file is None else posixpath.normpath(file.strip().replace("\\", "/"))
        mine = [n for n in nodes if n[0] == path and path is not None and (kind == "file" or n[1] == (name or "") and name)]
        if not mine:
            out.append((aid, "missing"))
        elif all(n[3] is not None for n in mine):
            out.append((aid, "deleted"))
        elif all(n[2] is not None for n in mine) and when.get(did) is not None and min(n[2] for n in mine) > when[did]:
            out.append((aid, "late"))
    return sorted(out)


ANCHOR = "anchor_id long, decision_id long, anchor_kind string, anchor_file string, anchor_name string"


def test_orphans_against_brute_force(spark):
    r = random.Random(5)
    day = [dt.datetime(2025, m, 3, 12) for m in range(1, 13)]
    nodes = [(f"r/f{r.randrange(9)}.ts", r.choice(["a", "b", None]), r.choice([*day, None]), r.choice([None, day[-1]])) for _ in range(60)]
    decisions = [(i, r.choice([*day, None])) for i in range(40)]
    spell = [lambda p: p, lambda p: " " + p, lambda p: p.replace("/", "\\"), lambda p: p.replace("/", "//"), lambda p: "./x/../" + p]
    anchors = []
    for i in range(400):
        hot = r.random() < 0.4
        f = "r/f1.ts" if hot else r.choice([f"r/f{r.randrange(12)}.ts", None])
        anchors.append((i if r.random() > 0.02 else None, r.randrange(45), r.choice(["function", "file", "file", "other"]), f and r.choice(spell)(f), r.choice(["a", "b", "c", "", None])))
    anchors += anchors[:50]
    a = spark.createDataFrame(anchors, ANCHOR).withColumn("key", F.lit(1)).withColumn("t", F.lit("x"))
    d = spark.createDataFrame([(i, t and t.strftime("%Y-%m-%dT%H:%M:%S.000Z")) for i, t in decisions], "id long, created_at string")
    n = spark.createDataFrame([(i, *x) for i, x in enumerate(nodes)], "id long, file string, name string, indexed_at timestamp, removed_at timestamp")
    got = orphans.orphan_anchors(a, d, n)
    want = brute_orphans(anchors, decisions, nodes)
    assert rows(got, "anchor_id", "orphan_kind") == sorted(want, key=repr)
    report = orphans.orphan_report(a, d, n)
    assert rows(report.groupBy("orphan_kind").agg(F.sum("n_anchors").alias("n")), "orphan_kind", "n") == sorted(((k, len(list(v))) for k, v in itertools.groupby(sorted(w[1] for w in want))), key=repr)
    assert orphans.orphan_anchors(a.where("false"), d, n).count() == 0
    assert {r["orphan_kind"] for r in orphans.orphan_anchors(a, d, n.where("false")).collect()} == {"missing"}


# -- store and pipeline


def tree(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)


def test_index_tree(spark, tmp_path):
    root, store = str(tmp_path / "repo"), Store(spark, str(tmp_path / "store"))
    tree(root, {
        "a.ts": "export function foo() {}\nexport function foo() {}\nfunction User() {}\n", "b.ts": "import { foo } from './a'\nimport type { User } from './a'\nfunction User() {}\nexport function bar() { foo(); foo(); User(); ext(); x.y() }\n",
        "_app.tsx": "export function App() { return <a>{go()}</a> }\n", "a.test.ts": "function no() {}", "types.d.ts": "function no(): void", "dist/x.js": "function no() {}", "node_modules/m/i.js": "function no() {}", "v.config.mjs": "function no() {}",
        "c.js": "import { no } from './dist/x'\nexport const run = () => no()\n", "bad.ts": "function broken( {",
    })
    for _ in range(2):
        got = index_tree(spark, root, store)
        assert (got["files"], got["functions"], got["calls"], got["resolved"], got["unresolved"]) == (5, 6, 7, 3, 4)
        assert got["reasons"] == {"member_chain": 1, "external": 0, "default_import": 0, "namespace_import": 0, "barrel_miss": 1, "unknown_bare": 2}
        assert got["files_with_parse_errors"] == 1 and got["duplicate_warnings"] == [("a.ts", "foo")] and got["parse_failures"] == []
        assert store.table("nodes").count() == 6
        assert rows(store.table("edges"), "count") == [(1,), (2,)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    inputs = spark.createDataFrame([(0, "f.ts", "g", "function", 1, 2)], "ord long, file string, name string, kind string, start_line int, end_line int")
    assert rows(store.upsert_nodes(inputs), "ord", "id") == [(0, 1)]
    with pytest.raises(Refused):
        store.upsert_nodes(inputs.withColumn("kind", F.lit("class")))
    with pytest.raises(Refused):
        store.insert_edges(spark.createDataFrame([(1, 9, "calls")], "source_id long, target_id long, kind string"))
    store.insert_edges(spark.createDataFrame([(1, 1, "calls")], "source_id long, target_id long, kind string"))
    ok, message = store.record('{"decisions": [{"decision": "d", "anchors": [{"kind": "function", "file": "f.ts", "name": "g"}, {"kind": "function", "file": "f.ts", "name": "g"}, {"kind": "file", "file": "no.ts"}], "keywords": ["k1", "k2"]}]}', "2025-01-01T00:00:00.000Z", "s")
    assert ok and message == "recorded 1 decisions (ids: 1); anchors live: 1/2"
    ok, message = store.record('{"decisions": [{"decision": "d", "anchors": [{"kind": "file", "file": "f.ts"}], "keywords": ["k1"]}, {"decision": ""}]}', "t")
    assert not ok and message.count("\n") == 2
    assert store.table("decisions").count() == 1
    store.delete_nodes(spark.createDataFrame([(1,)], "id long"))
    assert store.table("edges").count() == 0 and store.table("decisions").count() == 1
    store.delete_decisions(spark.createDataFrame([(1,)], "id long"))
    assert store.table("decision_anchors").count() == 0 and store.table("decision_keywords").count() == 0
    reopened = Store(spark, str(tmp_path / "s"))
    assert reopened.table("nodes").count() == 0
