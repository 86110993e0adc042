"""Rows and records of every distinct term, and marks of terms too rare or too common.

Heavy-light aggregation. Terms that hold a large share of the rows are found
by a mergeable sketch and sent to all tasks (at most ``MOST_HEAVY``). Their rows
are counted in arrays of exact counters local to each task; the records that
hold them are gathered as one bit mask for each record, summed bit by bit in
local counter arrays again. Only the remaining terms are shuffled by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.heavy import heavy_keys
from knotwork.functions.text import uniform_keyword

#: Terms counted without a shuffle by term; a mask has one bit for each.
MOST_HEAVY = 62
#: A term with at least this share of all rows is heavy.
HEAVY_SHARE = 1 / 256


def _code(heavy: list[str]):
    """Place of the term in the list of heavy terms, null for others."""
    if not heavy:
        return F.lit(None).cast("int")
    pairs = [x for i, t in enumerate(heavy) for x in (F.lit(t), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), F.col("term"))


def uniform_terms(df: DataFrame, record: str, term: str) -> DataFrame:
    """record, term: the term in lower case and without white space around it; nulls stay."""
    return df.select(F.col(record).alias("record"), uniform_keyword(F.col(term)).alias("term"))


def term_counts(df: DataFrame, record: str, term: str) -> DataFrame:
    """term, n_rows, n_records, total_records.

    n_rows counts every row of the term, repeated ones too; n_records the
    different records that hold it; total_records is the number of different
    records of the whole table, those with null terms included. Null terms
    have no row in the result, a null record is no record. A term of nothing
    but white space is the term ''. An empty table gives an empty result.
    """
    rows = uniform_terms(df, record, term)
    heavy = heavy_keys(rows, "term", MOST_HEAVY, HEAVY_SHARE)
    coded = rows.withColumn("code", _code(heavy))
    # one row for each record: which heavy terms it holds; partly aggregated before the shuffle
    masks = coded.where(F.col("record").isNotNull()).groupBy("record").agg(
        F.expr("coalesce(bit_or(shiftleft(1L, code)), 0L)").alias("mask")
    )
    bits = [F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(len(heavy))]
    local = masks.agg(F.count(F.lit(1)).alias("total_records"), *bits)
    total = local.select("total_records")
    light = (
        coded.where(F.col("code").isNull() & F.col("term").isNotNull())
        .groupBy("term", "record")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("term")
        .agg(F.sum("n").alias("n_rows"), F.count("record").alias("n_records"))
    )
    if heavy:
        counters = coded.where(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))
        terms = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(t).alias("term"), F.coalesce(F.col(f"b{i}"), F.lit(0).cast("long")).alias("n_records")) for i, t in enumerate(heavy)])
        dense = local.select(F.explode(terms).alias("h")).select("h.*").join(F.broadcast(counters), "code")
        light = light.unionByName(dense.select("term", "n_rows", "n_records"))
    return light.crossJoin(F.broadcast(total))  # the one row of the total


def marked_terms(df: DataFrame, record: str, term: str, rare_below: int = 3, common_over: tuple[int, int] = (1, 20)) -> DataFrame:
    """term_counts with ``mark``: ``rare`` below ``rare_below`` records, ``common`` over that share of all records, else null.

    A term that is both is rare.
    """
    num, den = common_over
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * den > F.col("total_records") * num, "common")
    return term_counts(df, record, term).withColumn("mark", mark)
