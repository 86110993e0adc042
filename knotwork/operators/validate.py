"""Nested input of the write path: every fault as a row, nothing written if there is one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The form of a keyword, and how many errors a message shows.
KEYWORD_FORM = r"^[a-z][a-z0-9-]{0,38}[a-z0-9]$"
ERRORS_SHOWN = 50
_KEYWORD = re.compile(KEYWORD_FORM[1:-1])


def _anchor_faults(a: object, at: str) -> list[str]:
    if not isinstance(a, dict):
        return [f"{at} must be an object"]
    out = []
    if a.get("kind") not in ("function", "file") or not isinstance(a.get("kind"), str):
        out.append(f"{at}.kind must be 'function' or 'file'")
    if not isinstance(a.get("file"), str) or not a["file"]:
        out.append(f"{at}.file must be a non-empty string")
    if a.get("kind") == "function" and (not isinstance(a.get("name"), str) or not a["name"]):
        out.append(f"{at}.name required when kind='function'")
    if a.get("kind") == "file" and "name" in a:
        out.append(f"{at} must not include 'name' when kind='file'")
    return out


def _keyword_faults(ks: object, at: str) -> list[str]:
    if not isinstance(ks, list):
        return [f"{at} must be an array"]
    if not ks:
        return [f"{at} must be non-empty"]
    out, seen = [], set()
    for i, k in enumerate(ks):
        if not isinstance(k, str):
            out.append(f"{at}[{i}] must be a string")
        elif not _KEYWORD.fullmatch(k):
            out.append(f'{at}[{i}] "{k}" must match {KEYWORD_FORM}')
        elif k in seen:
            out.append(f'{at}[{i}] duplicate "{k}"')
        else:
            seen.add(k)
    return out


def _decision_faults(d: object, at: str) -> list[str]:
    if not isinstance(d, dict):
        return [f"{at} must be an object"]
    out = []
    if not isinstance(d.get("decision"), str) or not d["decision"]:
        out.append(f"{at}.decision must be a non-empty string")
    anchors = d.get("anchors")
    if not isinstance(anchors, list):
        out.append(f"{at}.anchors must be an array")
    elif not anchors:
        out.append(f"{at}.anchors must be non-empty")
    else:
        for i, a in enumerate(anchors):
            out += _anchor_faults(a, f"{at}.anchors[{i}]")
    return out + _keyword_faults(d.get("keywords"), f"{at}.keywords")


def faults(raw: str | None) -> list[str]:
    """All faults of a batch in order; text that is no JSON is no object."""
    try:
        args = json.loads(raw) if raw is not None else None
    except ValueError:
        args = None
    if not isinstance(args, dict):
        return ["arguments must be an object"]
    if not isinstance(args.get("decisions"), list):
        return ["decisions must be an array"]
    if not args["decisions"]:
        return ["decisions must be a non-empty array"]
    return [e for i, d in enumerate(args["decisions"]) for e in _decision_faults(d, f"decisions[{i}]")]


def batch_faults(batches: DataFrame, key: str, raw: str) -> DataFrame:
    """key, ord, error: every fault of every batch, in order from 0."""
    rows = batches.select(F.col(key).alias("key"), F.col(raw).alias("raw"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([(k, i, e) for k, r in zip(b["key"], b["raw"]) for i, e in enumerate(faults(r))], columns=["key", "ord", "error"])

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, ord int, error string").withColumnRenamed("key", key)


def fault_messages(found: DataFrame, key: str) -> DataFrame:
    """key, message: the first faults joined by lines, and how many more there are."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: x["error"])
    shown = F.array_join(F.slice("errors", 1, ERRORS_SHOWN), "\n")
    more = F.size("errors") - ERRORS_SHOWN
    return found.groupBy(key).agg(ordered.alias("errors")).select(key, F.when(more > 0, F.concat(shown, F.lit("\n... and "), more.cast("string"), F.lit(" more"))).otherwise(shown).alias("message"))


_RECORD = "struct<decisions:array<struct<decision:string,anchors:array<struct<kind:string,file:string,name:string>>,keywords:array<string>>>>"


def parsed_batches(batches: DataFrame, key: str, raw: str) -> DataFrame:
    """key, ord, decision, anchors, keywords of the decisions of sound batches; a batch with any fault gives none."""
    bad = batch_faults(batches, key, raw).select(key).distinct()
    sound = batches.join(bad, key, "left_anti")
    return sound.select(key, F.posexplode(F.from_json(raw, _RECORD)["decisions"]).alias("ord", "d")).select(key, "ord", "d.*")
