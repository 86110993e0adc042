"""Imports to files, calls to definitions, and weighted call edges; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.paths import join_path
from knotwork.schemas import REASONS

# Fixed value: what a specifier may stand for, in the order of probing.
_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
PROBES = (*_EXTENSIONS, *("/index" + e for e in _EXTENSIONS), "")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def explode_functions(parsed: DataFrame) -> DataFrame:
    """file, ord, name, start_line, end_line, calls of every function."""
    return parsed.select("file", F.posexplode("functions").alias("ord", "f")).select("file", "ord", "f.*")


def explode_imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("imports").alias("ord", "i")).select("file", "ord", "i.*")


def explode_calls(parsed: DataFrame) -> DataFrame:
    """file, caller, caller_ord, ord, callee: every call site."""
    f = explode_functions(parsed)
    return f.select("file", F.col("name").alias("caller"), F.col("ord").alias("caller_ord"), F.posexplode("calls").alias("ord", "callee"))


def first_definitions(functions: DataFrame) -> DataFrame:
    """Of functions of one name in a file the first."""
    return first_by(functions, ["file", "name"], ["ord"])


def duplicate_definitions(functions: DataFrame) -> DataFrame:
    """file, name, n_dropped: later functions of a name that its file has already."""
    return functions.groupBy("file", "name").agg((F.count(F.lit(1)) - 1).alias("n_dropped")).where("n_dropped > 0")


def candidates(specifier: Column, importer: Column) -> Column:
    """The paths that a relative specifier may stand for, in order; null for a package."""
    base = join_path(importer, specifier)
    return F.when(specifier.startswith(".") | specifier.startswith("/"), F.array(*[F.concat(base, F.lit(p)) for p in PROBES]))


def resolve_imports(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """Imports with resolved_file: the first candidate that is a file, null if external or not there.

    listing is every file on disk, ignored ones included. Each different
    (folder, specifier) is probed once, in one join with the listing.
    """
    folder = F.regexp_replace("file", r"[^/]*\z", "")
    wanted = imports.select(folder.alias("folder"), "module_specifier").distinct()
    probes = wanted.select("folder", "module_specifier", F.posexplode(candidates(F.col("module_specifier"), F.concat("folder", F.lit("x")))).alias("pos", "path"))
    files = listing.select(F.col("file").alias("path")).where(F.col("path").isNotNull()).distinct()
    hit = probes.join(files, "path").groupBy("folder", "module_specifier").agg(F.min_by("path", "pos").alias("resolved_file"))
    return imports.withColumn("folder", folder).join(hit, ["folder", "module_specifier"], "left").drop("folder")


def resolve_calls(calls: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls with target_file, target_name and reason; exactly one of target and reason is null.

    A call with a dot is a member chain. Else the first import of that local
    name in the file decides, without falling back: not on disk is external,
    then namespace, then default; its name in the resolved file, or a miss. Only
    without an import the function of that name in the same file counts. Both
    lookups are one join, as the key is chosen before.
    """
    first = first_by(imports, ["file", "local_name"], ["ord"]).select(
        "file", F.col("local_name").alias("callee"), "imported_name", "is_default", "is_namespace", "resolved_file", F.lit(True).alias("imported")
    )
    c = calls.join(first, ["file", "callee"], "left")
    chain = F.col("callee").contains(".")
    has = F.coalesce("imported", F.lit(False))
    early = (
        F.when(chain, "member_chain")
        .when(has & F.col("resolved_file").isNull(), "external")
        .when(has & F.col("is_namespace"), "namespace_import")
        .when(has & F.col("is_default"), "default_import")
    )
    keyed = c.withColumn("early", early).withColumn("k_file", F.when(F.col("early").isNull(), F.when(has, F.col("resolved_file")).otherwise(F.col("file")))).withColumn(
        "k_name", F.when(F.col("early").isNull(), F.when(has, F.col("imported_name")).otherwise(F.col("callee")))
    )
    # only calls that have a key meet the registry: settled ones would all share the null key
    registry = nodes.select(F.col("file").alias("target_file"), F.col("name").alias("target_name")).distinct()
    open_ = keyed.where(F.col("early").isNull()).join(registry, (F.col("k_file") == F.col("target_file")) & (F.col("k_name") == F.col("target_name")), "left")
    miss = F.when(F.col("target_file").isNull(), F.when(has, "barrel_miss").otherwise("unknown_bare"))
    settled = keyed.where(F.col("early").isNotNull()).select(*calls.columns, F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("string").alias("target_name"), F.col("early").alias("reason"))
    return open_.select(*calls.columns, "target_file", "target_name", miss.alias("reason")).unionByName(settled)


def call_edges(resolved: DataFrame) -> DataFrame:
    """source_file, source_name, target_file, target_name, kind, count: resolved call sites by both ends."""
    return (
        resolved.where(F.col("reason").isNull())
        .groupBy(F.col("file").alias("source_file"), F.col("caller").alias("source_name"), "target_file", "target_name")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("kind", F.lit("calls"))
    )


def reason_counts(resolved: DataFrame) -> DataFrame:
    """reason, n of all six reasons, zeros included."""
    counts = resolved.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])).alias("x")).select("x.*")


def totals(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: files, functions, calls, resolved, unresolved, reasons, files_with_parse_errors."""
    a = parsed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("functions")), F.lit(0)).alias("functions"), F.count_if("had_parse_errors").alias("files_with_parse_errors"))
    b = resolved.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("reason").isNull()).alias("resolved"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    reasons = F.create_map(*[x for r in REASONS for x in (F.lit(r), F.col(r))])
    return a.crossJoin(b).select("files", "functions", "calls", "resolved", (F.col("calls") - F.col("resolved")).alias("unresolved"), reasons.alias("reasons"), "files_with_parse_errors")
