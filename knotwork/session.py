"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("knotwork")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the workers of a session, once."""
    sc = spark.sparkContext
    if getattr(sc, "_knotwork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    inside = shared if shared.startswith("/") else None
    if inside:
        os.makedirs(inside, exist_ok=True)
    folder = Path(tempfile.mkdtemp(prefix="knotwork-", dir=inside))
    with zipfile.ZipFile(folder / "knotwork.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"knotwork/{f.relative_to(root)}")
    sc.addPyFile(str(folder / "knotwork.zip"))  # the driver serves it to the executors
    sc._knotwork_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder of the cluster.

    The folder is the session's ``spark.checkpoint.dir``; only a session that
    names none (a local one, as in tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="knotwork-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_all(*cols) -> F.Column:
    """True where none of the columns is null."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out
