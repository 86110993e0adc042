"""Workspace paths as column expressions; all of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions.text import trim_white


def fold_segments(parts: Column) -> Column:
    """Segments without '', '.' and with each '..' taking back the one before.

    A '..' with nothing before it is kept, as it leads out of the root.
    """
    kept = F.filter(parts, lambda s: (s != "") & (s != "."))
    return F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def uniform_path(c: Column, windows: bool = True) -> Column:
    """One form for all spellings of a path from the workspace root.

    White space around it, separator kind, doubled separators, '.' and 'x/..'
    mean nothing; letter case does. Null stays null. Only paths that need it
    pay for the segment fold.
    """
    p = trim_white(c)
    if windows:
        p = F.translate(p, "\\", "/")
    plain = ~p.rlike(r"//|(^|/)\.\.?(/|$)|^/|/$")
    return F.when(plain, p).otherwise(F.array_join(fold_segments(F.split(p, "/")), "/"))


def join_path(importer: Column, specifier: Column) -> Column:
    """Specifier seen from the folder of the importing file, from the root; '..' above the root is kept."""
    folder = F.regexp_replace(importer, r"[^/]*$", "")
    whole = F.when(specifier.startswith("/"), specifier).otherwise(F.concat(folder, specifier))
    folded = F.array_join(fold_segments(F.split(whole, "/")), "/")
    return F.when(specifier.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)
