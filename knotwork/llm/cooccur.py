"""Pairs of items that occur in the same records, and their lift.

Heavy-light decomposition. The most frequent items (at most ``MOST_HEAVY``,
found by a sketch) form a dense bit matrix, one row of bits for each item over
the records of a partition: their pairs are counted by popcounts of rows
anded. Pairs of the remaining items are counted in hash tables. A mixed pair is
counted by probing the records of the light item for heavy items. The three
kinds of pairs are disjoint and united.

Two exact bounds prune before any pair is made: an item in fewer than
``least_together`` records has no pair that is frequent enough, and as a pair
is in no more records than its rarer item, an item in more than 1/lift of all
records has none that lies enough above chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.heavy import heavy_keys
from knotwork.llm.termfreq import uniform_terms

#: Rows of the bit matrix.
MOST_HEAVY = 128
#: An item with at least this share of all rows is heavy.
HEAVY_SHARE = 1 / 1024
#: Columns of the bit matrix handled at once.
BLOCK = 1 << 16
#: Items of a record that are paired in one row; longer records are split and their parts paired.
PART = 256


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of heavy codes: from lists of codes to counts over the partition."""
    total = np.zeros((MOST_HEAVY, MOST_HEAVY), dtype=np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    columns = 0

    def add() -> None:
        dense = np.zeros((MOST_HEAVY, columns), dtype=bool)
        at = 0
        for codes, ends in held:
            rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            dense[codes, at + rows] = True
            at += len(ends) - 1
        bits = np.packbits(dense, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        for a in range(MOST_HEAVY - 1):
            if bits[a].any():
                total[a, a + 1 :] += np.bitwise_count(bits[a] & bits[a + 1 :]).sum(axis=1, dtype=np.int64)

    for batch in batches:
        lists = batch.column(0)
        held.append((lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()))
        columns += len(lists)
        if columns >= BLOCK:
            add()
            held, columns = [], 0
    if columns:
        add()
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b], pa.int64())], ["a", "b", "n"])


def _ordered(x: str, y: str, n_x: str, n_y: str) -> list:
    first = F.col(x) < F.col(y)
    return [
        F.least(x, y).alias("item_a"),
        F.greatest(x, y).alias("item_b"),
        F.when(first, F.col(n_x)).otherwise(F.col(n_y)).alias("n_a"),
        F.when(first, F.col(n_y)).otherwise(F.col(n_x)).alias("n_b"),
    ]


def pair_lift(df: DataFrame, record: str, item: str, least_together: int = 5, lift: int = 4) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n, lift of pairs with n_ab >= least_together and n_ab * n >= lift * n_a * n_b.

    n_ab, n_a, n_b and n count different records: those with both items, with
    either one, and all of the table. Items are in lower case without white
    space around them, and item_a < item_b by code points. Null items and null
    records pair with nothing; a repeated (record, item) counts once. No pairs,
    or an empty table, give an empty result.
    """
    if lift < 1 or least_together < 1:
        raise ValueError("lift and least_together are at least 1")
    rows = uniform_terms(df, record, item).where(F.col("record").isNotNull())
    heavy = heavy_keys(rows, "term", MOST_HEAVY, HEAVY_SHARE)
    total = rows.agg(F.count_distinct("record").alias("n"))
    n = F.broadcast(total)  # one row
    named = rows.where(F.col("term").isNotNull())
    hot = F.col("term").isin(heavy) if heavy else F.lit(False)

    # light items: distinct rows, and their counts by partial aggregation, so that no task holds all rows of an item
    once = named.where(~hot).groupBy("term", "record").agg(F.lit(1).alias("one"))
    used = once.groupBy("term").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= least_together).crossJoin(n).where(F.col("n_item") * lift <= F.col("n"))
    light = once.join(used, "term").select("record", "term", "n_item")
    # long records are split, so that no task holds all items of one
    long = light.groupBy("record").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).where("parts > 1")
    sized = light.join(long, "record", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    packed = (
        sized.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
        .groupBy("record", "parts", "part")
        .agg(F.collect_list(F.struct("term", "n_item")).alias("items"))
    )

    def crossed(left: str, right: str):
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("x"), y.alias("y")))))

    later = F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    whole = packed.where("parts = 1").select(F.explode(F.flatten(later)).alias("p"))
    # every two parts of a long record meet in a task of their own
    cut = packed.where("parts > 1")
    met = cut.select("record", "part", "items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    low = met.where("part <= other").select("record", F.col("part").alias("i"), F.col("other").alias("j"), F.col("items").alias("l"))
    high = met.where("other <= part").select("record", F.col("other").alias("i"), F.col("part").alias("j"), F.col("items").alias("r"))
    across = low.join(high, ["record", "i", "j"]).select(
        F.explode(F.when(F.col("i") < F.col("j"), crossed("l", "r")).otherwise(F.filter(crossed("l", "r"), lambda p: p["x"]["term"] < p["y"]["term"]))).alias("p")
    )
    both_light = (
        whole.unionByName(across)
        .select(*_ordered("p.x.term", "p.y.term", "p.x.n_item", "p.y.n_item"))
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    )
    out = both_light
    if heavy:
        pairs = [v for i, t in enumerate(heavy) for v in (F.lit(t), F.lit(i))]
        held = (
            named.where(hot)
            .select("record", F.try_element_at(F.create_map(*pairs), F.col("term")).alias("code"))
            .groupBy("record")
            .agg(F.array_sort(F.collect_set("code")).alias("codes"))  # at most MOST_HEAVY codes
        )
        schema = "a int, b int, n long"
        names = F.array(*[F.lit(t) for t in heavy])
        counts = held.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_item"))
        counts = F.broadcast(counts)  # at most MOST_HEAVY rows
        dense = held.select("codes").mapInArrow(_popcounts, schema).groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
        ca, cb = counts.select(F.col("code").alias("a"), F.col("n_item").alias("n_x")), counts.select(F.col("code").alias("b"), F.col("n_item").alias("n_y"))
        dense = dense.join(F.broadcast(ca), "a").join(F.broadcast(cb), "b").select(names[F.col("a")].alias("x"), names[F.col("b")].alias("y"), "n_ab", "n_x", "n_y")
        mixed = (
            light.join(held, "record")
            .select("term", "n_item", F.explode("codes").alias("code"))
            .groupBy("term", "code")
            .agg(F.count(F.lit(1)).alias("n_ab"), F.first("n_item").alias("n_x"))
            .join(F.broadcast(counts.select("code", F.col("n_item").alias("n_y"))), "code")
            .select(F.col("term").alias("x"), names[F.col("code")].alias("y"), "n_ab", "n_x", "n_y")
        )
        out = out.unionByName(dense.unionByName(mixed).select("n_ab", *_ordered("x", "y", "n_x", "n_y")))
    return (
        out.where(F.col("n_ab") >= least_together)
        .crossJoin(n)
        .where(F.col("n_ab") * F.col("n") >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
        .withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift")
    )
