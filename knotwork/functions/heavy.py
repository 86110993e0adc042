"""Heavy keys of a column: a list of bounded length, found in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch follows at once, in each task and after merging.
TRACKED = 8192


def heavy_keys(df: DataFrame, key: str, most: int, share: float) -> list[str]:
    """At most ``most`` keys, each estimated to hold at least ``share`` of the rows.

    The estimate comes from a mergeable frequent-items sketch over all rows,
    so any key above the sketch's error is in the list. A key that is missed or
    listed in error only changes where it is counted, never what is counted.
    Null keys don't count. The list goes to the driver; it has ``most`` entries.
    """
    row = (
        df.where(F.col(key).isNotNull())
        .agg(F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
        .first()
    )
    if not row or not row["n"] or not row["top"]:
        return []
    least = max(2.0, share * row["n"])
    return sorted(x["item"] for x in row["top"] if x["count"] >= least)
