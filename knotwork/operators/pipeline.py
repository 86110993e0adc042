"""A source tree to a stored call graph."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import resolve as R
from knotwork.operators.store import Store
from knotwork.session import cut
from knotwork.sources.files import file_listing, parse_tree


def resolve_parsed(parsed: DataFrame, listing: DataFrame) -> DataFrame:
    """Every call site of parsed files with its target or reason."""
    imports = R.resolve_imports(R.explode_imports(parsed), listing)
    return R.resolve_calls(R.explode_calls(parsed), imports, R.explode_functions(parsed))


def index_tree(spark: SparkSession, root: str, store: Store) -> dict:
    """Scans root, rebuilds nodes and edges, and gives the totals, failures and duplicates of the run."""
    start = time.time()
    listing = file_listing(spark, root)
    parsed = cut(parse_tree(spark, root, listing))
    sound = parsed.where(F.col("error").isNull())
    resolved = cut(resolve_parsed(sound, listing))
    store.replace_graph(R.explode_functions(sound).select("file", "name", "start_line", "end_line"), R.call_edges(resolved))
    out = R.totals(sound, resolved).first().asDict(recursive=True)
    out["parse_failures"] = [(r["file"], r["error"]) for r in parsed.where(F.col("error").isNotNull()).select("file", "error").orderBy("file").collect()]
    dup = sound.select("file", F.explode("duplicate_function_names").alias("name")).orderBy("file", "name")
    out["duplicate_warnings"] = [(r["file"], r["name"]) for r in dup.collect()]
    out["duration_ms"] = int((time.time() - start) * 1000)
    return out
