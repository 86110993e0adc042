"""Source trees: discovery on the driver, reading and parsing in the workers.

Only paths go through the driver. Spark's own text and binary readers skip names
that begin with '_' or '.', which a source tree may well have.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.schemas import PARSED_FILE
from knotwork.session import ship

# What a scan takes and what it leaves out.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
IGNORED_FOLDERS = ("node_modules", "dist", "build", "out", ".git", ".ctx", "__tests__", ".next", ".turbo", ".vercel", ".cache", "coverage")
IGNORED_ENDINGS = (
    ".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js", ".config.ts", ".config.tsx", ".config.js", ".config.mjs", ".config.cjs", ".d.ts", ".min.js", ".bundle.js",
)


def list_files(root: str) -> list[str]:
    """All regular files under root, as sorted paths from it; links to folders are not followed."""
    root = os.path.abspath(root)
    found = []
    for folder, _, names in os.walk(root, followlinks=False):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        for n in names:
            if os.path.isfile(os.path.join(folder, n)):
                found.append(n if rel == "." else f"{rel}/{n}")
    return sorted(found)


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """file: the whole listing, what a scan ignores included, for import resolution."""
    return spark.createDataFrame([(f,) for f in list_files(root)], "file string")


def scanned(file: Column) -> Column:
    """Whether a scan takes the file: known extension, not in an ignored or hidden folder, no ignored ending."""
    folders = "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS)
    endings = "|".join(e.replace(".", r"\.") for e in IGNORED_ENDINGS)
    return (
        file.rlike(rf"\.(?:{'|'.join(EXTENSIONS)})\z")
        & ~file.rlike(rf"(?:^|/)(?:{folders})/")
        & ~file.rlike(rf"(?:{endings})\z")
        & ~file.rlike(r"(?:^|/)\.[^/]")
    )


def language(file: Column) -> Column:
    """typescript, tsx or javascript by the extension in any case; null for other files."""
    ext = F.lower(F.regexp_extract(file, r"\.([^./]+)\z", 1))
    return F.when(ext == "ts", "typescript").when(ext == "tsx", "tsx").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript")


def _extracted(file: str, text: str | None, error: str | None) -> tuple:
    from knotwork.parser.grammar import extract, grammar_of

    if error is not None:
        return file, None, None, None, None, error
    grammar = grammar_of(file)
    try:
        r = extract(text or "", "jsx" if grammar == "javascript" else grammar)
    except Exception as e:  # noqa: BLE001 - one file never ends the scan
        return file, None, None, None, None, str(e) or type(e).__name__
    return file, r["functions"], r["imports"], r["had_parse_errors"], r["duplicate_function_names"], None


def extract_texts(df: DataFrame, file: str = "file", text: str = "source_text") -> DataFrame:
    """PARSED_FILE rows of texts at hand; files of unknown languages are left out, a null text is an empty one."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_extracted(f, t, None) for f, t in zip(b["file"], b["text"])], columns=PARSED_FILE.fieldNames())

    rows = df.select(F.col(file).alias("file"), F.col(text).alias("text")).where(language(F.col("file")).isNotNull())
    return rows.mapInPandas(run, PARSED_FILE)


def parse_tree(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """PARSED_FILE rows of the scanned files under root, which all workers must see; a file that fails has an error."""
    ship(spark)
    base = os.path.abspath(root)
    files = (listing if listing is not None else file_listing(spark, root)).where(scanned(F.col("file")) & language(F.col("file")).isNotNull())

    def read(path: str) -> tuple[str | None, str | None]:
        try:
            with open(path, encoding="utf-8", errors="replace", newline="") as f:
                return f.read(), None
        except OSError as e:
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_extracted(f, *read(os.path.join(base, f))) for f in b["file"]], columns=PARSED_FILE.fieldNames())

    return files.mapInPandas(run, PARSED_FILE)
