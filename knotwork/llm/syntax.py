"""Source files that are not valid in the language of their extension.

Every text is parsed against all grammars, the likeliest by its tokens first. A
text that only a foreign grammar takes has a wrong extension; one that none
takes is corrupt. Parsing is a narrow map in the scan's own tasks; only verdicts
are shuffled, never texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.parser.grammar import GRAMMARS, grammar_of, syntax_of

_VERDICT = "repo string, file string, indexed_at timestamp, tie long, language string, valid boolean, accepted array<string>"


def _language():
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".ts", ".tsx"), "typescript").when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ties, language, valid, accepted = [], [], [], []
        for file, text in zip(b.column("file").to_pylist(), b.column("source_text").to_pylist()):
            own = grammar_of(file)
            ties.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else -1)
            language.append(None if own is None else "typescript" if GRAMMARS[own][0] else "javascript")
            if own is None:
                valid.append(None)
                accepted.append(None)
            else:
                ok, some = syntax_of(text or "", own)
                valid.append(ok)
                accepted.append(some)
        yield pa.RecordBatch.from_arrays(
            [b.column("repo"), b.column("file"), b.column("indexed_at"), pa.array(ties, pa.int64()), pa.array(language, pa.string()), pa.array(valid, pa.bool_()), pa.array(accepted, pa.list_(pa.string()))],
            ["repo", "file", "indexed_at", "tie", "language", "valid", "accepted"],
        )


def file_syntax(parsed_files: DataFrame) -> DataFrame:
    """repo, file, language, valid, fault, accepted: one row for each file, from its row with the latest indexed_at.

    ``accepted`` has the grammars that take the text; ``fault`` is null,
    ``wrong_extension`` or ``corrupt``. A null indexed_at is the earliest, and of
    rows equally late the one with the greater checksum counts. A null text is
    an empty one, which is valid. A file of another extension has null verdicts;
    rows without a file are left out.
    """
    rows = parsed_files.where(F.col("file").isNotNull()).select("repo", "file", F.col("indexed_at").cast("timestamp").alias("indexed_at"), "source_text")
    return (
        rows.mapInArrow(_verdicts, _VERDICT)
        .groupBy("file")
        .agg(F.max(F.struct("indexed_at", "tie", "repo", "language", "valid", "accepted")).alias("r"))
        .select("r.repo", "file", "r.language", "r.valid", "r.accepted")
        .withColumn("fault", F.when(~F.col("valid"), F.when(F.size("accepted") > 0, "wrong_extension").otherwise("corrupt")))
    )


def known_failures(pipeline_results: DataFrame) -> DataFrame:
    """repo, file, language: every file that some run failed on, once; nulls are left out."""
    return (
        pipeline_results.select("repo", F.explode("parse_failures").alias("f"))
        .select("repo", F.col("f.file").alias("file"))
        .where(F.col("file").isNotNull())
        .groupBy("file")
        .agg(F.min("repo").alias("repo"))
        .withColumn("language", _language())
    )


def invalid_files(parsed_files: DataFrame, pipeline_results: DataFrame) -> DataFrame:
    """repo, file, language, fault of every file at fault; ``unparsed`` are those only the runs' failures know."""
    verdicts = file_syntax(parsed_files)
    unknown = known_failures(pipeline_results).join(parsed_files.select("file").where(F.col("file").isNotNull()).distinct(), "file", "left_anti")
    return (
        verdicts.where(~F.col("valid"))
        .select("repo", "file", "language", "fault")
        .unionByName(unknown.select("repo", "file", "language", F.lit("unparsed").alias("fault")))
    )


def invalid_rates(parsed_files: DataFrame, pipeline_results: DataFrame) -> DataFrame:
    """repo, language, n_files, n_invalid, rate over parsed files and files only known from failures."""
    verdicts = file_syntax(parsed_files).where(F.col("valid").isNotNull()).select("repo", "language", F.col("valid"))
    unknown = known_failures(pipeline_results).join(parsed_files.select("file").where(F.col("file").isNotNull()).distinct(), "file", "left_anti")
    return (
        verdicts.unionByName(unknown.select("repo", "language", F.lit(False).alias("valid")))
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
