"""Texts made of decisions: what a read shows, listings by keyword, tool description, index summary."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import sessions as S
from knotwork.schemas import REASONS

# Room of a text in characters, room kept for its footer, entries of a listing, keywords of a description.
BUDGET, FOOTER, LISTED, DESCRIBED = 8000, 200, 50, 100
#: Stands before every rendered text; the product's name, if it has one.
PREFIX = "[decisions]"


def relative_path(path: Column, cwd: Column) -> Column:
    """An absolute path under cwd from there, a relative one as it is; null if outside."""
    root = F.when(cwd.endswith("/"), cwd).otherwise(F.concat(cwd, F.lit("/")))
    absolute = F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path)))
    return F.when(path.startswith("/"), absolute).when(~path.startswith("../"), path)


def hook_events(raw: DataFrame, column: str = "value", default_cwd: str | None = None) -> DataFrame:
    """seq, session_id, file of raw JSON events; broken ones, and reads outside their folder, are left out."""
    schema = "tool_input struct<file_path:string>, session_id string, cwd string"
    e = raw.withColumn("e", F.from_json(column, schema))
    cwd = F.coalesce("e.cwd", F.lit(default_cwd))
    return (
        e.where((F.coalesce("e.tool_input.file_path", F.lit("")) != "") & (F.coalesce(cwd, F.lit("")) != ""))
        .select("seq", F.coalesce("e.session_id", F.lit("_default")).alias("session_id"), relative_path(F.col("e.tool_input.file_path"), cwd).alias("file"))
        .where(F.col("file").isNotNull())
    )


def decision_line(keywords: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), ", "), F.lit("] "), text)


def anchor_line(kind: Column, file: Column, name: Column, live: Column) -> Column:
    state = F.when(live, " (live)").otherwise(" (dead)")
    return F.when(kind == "function", F.concat(F.lit("function "), file, F.lit("::"), name, state)).otherwise(F.concat(F.lit("file "), file, state))


def _within_budget(head: Column, body: Column, n_body: Column, foot: Column, total: Column) -> Column:
    """Lines joined; if longer than the budget, as many as fit beside a footer that counts the rest.

    body may hold only the first of the n_body lines, if those are over the budget.
    """
    all_there = F.size(body) == n_body
    lines = F.concat(head, body, F.when(all_there, foot).otherwise(F.array().cast("array<string>")))
    n_lines = F.size(head) + n_body + F.size(foot)
    whole = F.array_join(lines, "\n")
    fits = F.aggregate(
        lines,
        F.struct(F.lit(-1).alias("length"), F.lit(0).alias("kept"), F.lit(True).alias("open")),
        lambda a, x: F.when(
            a["open"] & (a["length"] + 1 + F.length(x) <= BUDGET - FOOTER),
            F.struct((a["length"] + 1 + F.length(x)).alias("length"), (a["kept"] + 1).alias("kept"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["length"].alias("length"), a["kept"].alias("kept"), F.lit(False).alias("open"))),
        lambda a: a["kept"],
    )
    footer = F.concat(F.lit("\n("), (n_lines - fits).cast("string"), F.lit(" additional lines truncated; "), total.cast("string"), F.lit(" decisions total on this file; list them by keyword)"))
    return F.when(all_there & (F.length(whole) <= BUDGET), whole).otherwise(F.concat(F.array_join(F.slice(lines, 1, fits), "\n"), F.lit("\n"), footer))


def render_reads(counts: DataFrame, new: DataFrame, decisions: DataFrame, anchors: DataFrame, keywords: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """seq, session_id, file, text for every read that meets decisions.

    counts: seq, session_id, file, total, new_cnt of the reads; new: seq,
    session_id, file, decision_id of what they show first. New decisions with an
    anchor on the whole file stand once under ``file-level:``; others once under
    each of their functions there, in order of the names; the newest first.
    Nothing new gives a hint of two lines.
    """
    a = anchors.where(F.col("anchor_file").isNotNull()).select("decision_id", F.col("anchor_file").alias("file"), "anchor_kind", "anchor_name").distinct()
    places = a.groupBy("decision_id", "file").agg(
        F.max((F.col("anchor_kind") == "file").cast("int")).alias("whole"), F.array_sort(F.collect_set(F.when(F.col("anchor_kind") == "function", F.col("anchor_name")))).alias("names")
    )
    kw = keywords.groupBy("decision_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    texts = decisions.select(F.col("id").alias("decision_id"), "decision", "created_at").join(kw, "decision_id", "left")
    read = ["seq", "session_id"]
    told = (
        new.join(places, ["decision_id", "file"])
        .join(texts, "decision_id")
        .select(*read, F.explode(F.when(F.col("whole") == 1, F.array(F.lit(""))).otherwise(F.col("names"))).alias("place"), "created_at", "decision_id", F.concat(F.lit("  "), decision_line(F.col("keywords"), F.coalesce("decision", F.lit("")))).alias("line"))
    )
    title = F.when(F.col("place") == "", "file-level:").otherwise(F.concat(F.lit("fn "), F.col("place"), F.lit("():")))
    titles = told.select(*read, "place").distinct().select(*read, "place", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast(told.schema["decision_id"].dataType).alias("decision_id"), title.alias("line"))
    lines = titles.unionByName(told.withColumn("rank", F.lit(1)))
    # a running length leaves of a read with very many lines only those that may be shown
    w = Window.partitionBy(*read).orderBy("place", "rank", F.desc_nulls_last("created_at"), "decision_id")
    ordered = lines.withColumn("n", F.row_number().over(w)).withColumn("until", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bodies = ordered.groupBy(*read).agg(
        F.count(F.lit(1)).cast("int").alias("n_body"), F.transform(F.array_sort(F.collect_list(F.when(F.col("until") <= BUDGET, F.struct("n", "line")))), lambda x: x["line"]).alias("body")
    )
    heads = counts.select(*read, "file", "total", F.col("new_cnt").alias("fresh"))
    seen = F.col("total") - F.col("fresh")
    header = F.concat(
        F.lit(f"{prefix} "), F.col("total").cast("string"), F.lit(" decisions on "), F.col("file"), F.lit(" ("), F.col("fresh").cast("string"), F.lit(" new"),
        F.when(seen > 0, F.concat(F.lit(", "), seen.cast("string"), F.lit(" shown earlier"))).otherwise(""), F.lit(")"),
    )
    footer = F.when(
        seen > 0,
        F.array(F.lit(""), F.concat(F.lit("("), seen.cast("string"), F.lit(" decision"), F.when(seen > 1, "s").otherwise(""), F.lit(" on this file already shown earlier this session.")), F.lit("If your context was compacted, reset the decision cache.)")),
    ).otherwise(F.array().cast("array<string>"))
    hint = F.concat(F.lit(f"{prefix} "), F.col("total").cast("string"), F.lit(" decisions on "), F.col("file"), F.lit(" shown earlier this session.\n(reset the decision cache if context was compacted)"))
    text = _within_budget(F.array(header, F.lit(""), F.lit("NEW:")), F.coalesce("body", F.array().cast("array<string>")), F.coalesce("n_body", F.lit(0)), footer, F.col("total"))
    return heads.join(bodies, read, "left").select(*read, "file", F.when(F.col("fresh") == 0, hint).otherwise(text).alias("text"))


def inject(raw: DataFrame, decisions: DataFrame, anchors: DataFrame, keywords: DataFrame, default_cwd: str | None = None) -> DataFrame:
    """seq, session_id, file, reply of raw JSON events (seq, value): the reply of every read that meets decisions.

    op of raw tells reads from resets; without that column all are reads.
    """
    if "op" not in raw.columns:
        raw = raw.withColumn("op", F.lit("read"))
    resets = raw.where(F.col("op") != "read").select("seq", F.get_json_object("value", "$.session_id").alias("session_id"), "op", F.lit(None).cast("string").alias("file"))
    events = hook_events(raw.where(F.col("op") == "read"), default_cwd=default_cwd).select("seq", "session_id", F.lit("read").alias("op"), "file").unionByName(resets)
    pairs = anchors.select("decision_id", F.col("anchor_file").alias("file")).distinct()
    texts = render_reads(*S.served(events, pairs), decisions, anchors, keywords)
    return texts.select("seq", "session_id", "file", envelope(F.col("text")).alias("reply"))


def envelope(text: Column) -> Column:
    """The reply of a hook as JSON."""
    inner = F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("allow").alias("permissionDecision"), text.alias("additionalContext"))
    return F.to_json(F.struct(inner.alias("hookSpecificOutput")))


def keyword_listing(decisions: DataFrame, keywords: DataFrame, anchors_live: DataFrame, keyword: str) -> DataFrame:
    """One row, text: the decisions of a keyword, the newest first, at most LISTED, with keywords, anchors and liveness."""
    mine = keywords.where(F.col("keyword") == keyword).select(F.col("decision_id").alias("id")).distinct()
    hit = decisions.join(mine, "id", "left_semi")
    total = hit.agg(F.count(F.lit(1)).alias("n"))
    top = hit.orderBy(F.desc("created_at"), "id").limit(LISTED)
    kw = keywords.join(top.select(F.col("id").alias("decision_id")), "decision_id", "left_semi").groupBy("decision_id").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    an = (
        anchors_live.join(top.select(F.col("id").alias("decision_id")), "decision_id", "left_semi")
        .groupBy("decision_id")
        .agg(F.array_sort(F.collect_list(F.struct("anchor_kind", "anchor_file", "anchor_name", "live"))).alias("anchors"))
    )
    rows = top.join(kw, F.col("id") == kw["decision_id"], "left").join(an, F.col("id") == an["decision_id"], "left")
    head = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), decision_line(F.col("keywords"), F.coalesce("decision", F.lit(""))))
    listed = F.transform(F.coalesce("anchors", F.array()), lambda a: F.concat(F.lit("    "), anchor_line(a["anchor_kind"], a["anchor_file"], a["anchor_name"], a["live"])))
    entry = F.concat(F.array(head), F.when(F.size(listed) > 0, F.concat(F.array(F.lit("  anchors:")), listed)).otherwise(listed), F.array(F.lit("")))
    w = Window.orderBy(F.desc("created_at"), "id")  # at most LISTED rows
    entries = rows.withColumn("n_", F.row_number().over(w)).select("n_", entry.alias("entry")).agg(F.array_sort(F.collect_list(F.struct("n_", "entry"))).alias("e"))
    body = F.array_join(F.flatten(F.transform("e", lambda x: x["entry"])), "\n")
    title = F.concat(F.col("n").cast("string"), F.lit(" decision"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(f' tagged "{keyword}":\n\n'))
    more = F.when(F.col("n") > LISTED, F.concat(F.lit(f"\n({LISTED} of "), F.col("n").cast("string"), F.lit(" shown; refine the keyword)"))).otherwise("")
    return total.crossJoin(entries).select(F.when(F.col("n") == 0, F.lit(f'0 decisions tagged "{keyword}"')).otherwise(F.regexp_replace(F.concat(title, body, more), r"\s+\z", "")).alias("text"))


def keyword_reply(raw: str | None, decisions: DataFrame, keywords: DataFrame, anchors_live: DataFrame) -> DataFrame:
    """One row, ok and text: the listing by the keyword in raw JSON arguments, or what is wrong with them."""
    try:
        args = json.loads(raw) if raw is not None else None
    except ValueError:
        args = None
    fault = None if isinstance(args, dict) else "arguments must be an object"
    if fault is None and (not isinstance(args.get("keyword"), str) or not args["keyword"]):
        fault = "keyword must be a non-empty string"
    if fault is not None:
        return decisions.sparkSession.range(1).select(F.lit(False).alias("ok"), F.lit(fault).alias("text"))
    return keyword_listing(decisions, keywords, anchors_live, args["keyword"]).select(F.lit(True).alias("ok"), "text")


def keyword_help(keywords: DataFrame, intro: str = "Record decisions that a search of the code can't find.") -> DataFrame:
    """One row, text: the intro and the most used keywords, at most DESCRIBED."""
    v = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    size = v.agg(F.count(F.lit(1)).alias("all"))
    top = v.orderBy(F.desc("n"), "keyword").limit(DESCRIBED)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "keyword"))).alias("k"))
    names = F.array_join(F.transform("k", lambda x: x["keyword"]), ", ")
    cut_ = F.when(F.col("all") > DESCRIBED, F.concat(F.lit(f", top {DESCRIBED} of "), F.col("all").cast("string"))).otherwise("")
    block = F.when(F.col("all") > 0, F.concat(F.lit("\n\nEXISTING KEYWORDS (frequency desc"), cut_, F.lit("):\n"), names)).otherwise("")
    return size.crossJoin(listed).select(F.concat(F.lit(intro), block).alias("text"))


def first_three(df: DataFrame, label: Column, order: list[str], line: str) -> DataFrame:
    """One row, text: a line with the number of rows and the labels of the first three; empty without rows."""
    top = df.select(*order, label.alias("label")).orderBy(*order).limit(3)
    shown = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "label"))), lambda x: x["label"]), ", ").alias("shown"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(shown).select(F.when(F.col("n") > 0, F.concat(F.lit("\n  "), F.col("n").cast("string"), F.lit(f" {line}: "), F.col("shown"))).otherwise("").alias("text"))


def index_summary(totals: DataFrame, seconds: float, failures: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row, text: files, functions, calls and why calls stay unresolved; failures (file) and duplicates (file, name) with the first three of each."""
    share = F.floor(F.col("resolved") * 100 / F.col("calls") + 0.5).cast("string")
    buckets = F.array_join(F.array(*[F.concat(F.lit("    " + r.ljust(18) + " "), F.col("reasons")[r].cast("string")) for r in REASONS]), "\n")
    calls = F.when(
        F.col("calls") > 0,
        F.concat(F.lit("  "), F.col("calls").cast("string"), F.lit(" calls → "), F.col("resolved").cast("string"), F.lit(" resolved ("), share, F.lit("%), "), F.col("unresolved").cast("string"), F.lit(" unresolved:\n"), buckets),
    ).otherwise("  0 calls")
    broken = F.when(F.col("files_with_parse_errors") > 0, F.concat(F.lit("\n  "), F.col("files_with_parse_errors").cast("string"), F.lit(" files had parse errors (partial results used)"))).otherwise("")
    failed, twice = F.lit(""), F.lit("")
    if failures is not None:
        totals = totals.crossJoin(first_three(failures, F.col("file"), ["file"], "parse failures").withColumnRenamed("text", "failed"))
        failed = F.col("failed")
    if duplicates is not None:
        totals = totals.crossJoin(first_three(duplicates, F.concat("file", F.lit("::"), "name"), ["file", "name"], "duplicate function names dropped").withColumnRenamed("text", "twice"))
        twice = F.col("twice")
    head = F.concat(F.lit("Indexed "), F.col("files").cast("string"), F.lit(f" files in {seconds:.1f}s\n  "), F.col("functions").cast("string"), F.lit(" functions\n"))
    return totals.select(F.concat(head, calls, failed, broken, twice).alias("text"))
