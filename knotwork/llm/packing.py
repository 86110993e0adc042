"""Items of varying size in containers of fixed capacity, with little room unused.

The packing is computed on the histogram of sizes: at most as many distinct
sizes as the capacity, whatever the number of items. First the dominance
reduction of Martello and Toth fixes containers that no other choice can beat
(an item alone, an item with the largest one beside it, where no two smaller
ones could use the room better, or an item with the largest two, where no three
fit and no two could use the room otherwise), many at a time, until none is
left to fix. The
shrunken instance is packed best-fit in decreasing order, again whole classes
of equal containers at a time. The result is a list of events: items of one
size with ranks in a range go to containers in a range. Items get their rank
within their size in the cluster and are matched with the events.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut

#: Parts that the items of one size are numbered in; a size that holds a third of all items is spread over them.
SPREAD = 256


class _Sizes:
    """Sizes still to be packed and how many of each."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self.order = sorted(self.left)
        self.next = dict.fromkeys(self.left, 0)

    def take(self, size: int, n: int) -> int:
        """The first rank of n items of the size."""
        first = self.next[size]
        self.next[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.order.remove(size)
        return first

    def largest(self, room: int, beside: int) -> int:
        """The largest size that fits the room; of ``beside`` one item is already used. 0 if none."""
        i = bisect_right(self.order, room) - 1
        if i >= 0 and self.order[i] == beside and self.left[beside] < 2:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def smallest(self, many: int, beside: int) -> int:
        """The least sum of so many items other than one of ``beside``; 0 if there are not so many."""
        found: list[int] = []
        for s in self.order:
            n = self.left[s] - (s == beside)
            found += [s] * min(n, many)
            if len(found) >= many:
                return sum(found[:many])
        return 0

    def pairs(self, room: int, beside: int):
        """(larger, smaller) of two items that fit the room together, other than one of ``beside``: for each smaller one the largest."""
        fit = [s for s in self.order[: bisect_right(self.order, room)] if self.left[s] > (s == beside)]
        top = len(fit) - 1
        for i, y in enumerate(fit):
            while top > i and fit[top] + y > room:
                top -= 1
            if top > i:
                yield fit[top], y
            elif 2 * y <= room and self.left[y] - (y == beside) > 1:
                yield y, y
            else:
                return


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int, int]:
    """(events, containers, containers fixed by dominance) for sizes from 1 to capacity.

    An event is (size, first rank, past rank, first container, items of that
    size in each container).
    """
    sizes = _Sizes(counts)
    if sizes.order and sizes.order[-1] > capacity:
        raise ValueError("a size is above the capacity")
    events: list[tuple] = []
    used = 0
    changed = True
    while changed:
        changed = False
        for s in sorted(sizes.left, reverse=True):
            while s in sizes.left:
                room = capacity - s
                k = sizes.largest(room, s)
                if k == 0:
                    n = 1 if sizes.largest(room, 0) == s else sizes.left[s]
                    a = sizes.take(s, n)
                    events.append((s, a, a + n, used, 1))
                    used += n
                    changed = True
                    continue
                two = sizes.smallest(2, s)
                if k != room and two and two <= room:
                    three = sizes.smallest(3, s)
                    if three and three <= room:
                        break
                    # two at most beside it: pairs that the largest one alone can't stand for
                    better = [(x, y) for x, y in sizes.pairs(room, s) if x + y > k]
                    if better:
                        y = max(y for x, y in better if x == k) if any(x == k for x, _ in better) else 0
                        if not y or any(v > y for _, v in better):
                            break
                        each = Counter((s, k, y))
                        n = min(sizes.left[x] // m for x, m in each.items())
                        for x, m in each.items():
                            a = sizes.take(x, n * m)
                            events.append((x, a, a + n * m, used, m))
                        used += n
                        changed = True
                        continue
                if k == s:
                    n = sizes.left[s] // 2
                    a = sizes.take(s, 2 * n)
                    events.append((s, a, a + 2 * n, used, 2))
                else:
                    n = min(sizes.left[s], sizes.left[k])
                    a, b = sizes.take(s, n), sizes.take(k, n)
                    events += [(s, a, a + n, used, 1), (k, b, b + n, used, 1)]
                used += n
                changed = True
    fixed = used
    # classes of containers with equal room: (room, first container) -> how many
    rooms: list[tuple[int, int]] = []
    many: dict[tuple[int, int], int] = {}

    def open_class(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            insort(rooms, (room, first))
            many[room, first] = n

    for s in sorted(sizes.left, reverse=True):
        while s in sizes.left:
            n = sizes.left[s]
            i = bisect_right(rooms, (s, -1))
            if i < len(rooms):
                room, first = rooms.pop(i)
                m = many.pop((room, first))
            else:
                room, first, m = capacity, used, -(-n // (capacity // s))
                used += m
            each = room // s
            full = min(m, n // each)
            if full:
                a = sizes.take(s, full * each)
                events.append((s, a, a + full * each, first, each))
                open_class(room - each * s, first, full)
                n -= full * each
            if full < m:
                rest = 0
                if n:  # fewer than one container takes
                    a = sizes.take(s, n)
                    events.append((s, a, a + n, first + full, n))
                    open_class(room - n * s, first + full, 1)
                    rest = 1
                open_class(room, first + full + rest, m - full - rest) if room < capacity else None
    return events, used, fixed


def _pieces(items: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, capacity, key, part, size: items longer than a window are cut into full parts and the rest."""
    w = windows.where(F.col("window_id").isNotNull() & (F.col("capacity") > 0))
    whole = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1))
    return (
        items.crossJoin(F.broadcast(w))  # a handful of windows
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long") - 1)))
        .withColumn("size", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("part") * F.col("capacity")))
    )


def pack(items: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """window_id, bin, key, part, tokens: for every window the container of every item.

    items has the key and ``tokens``; windows has ``window_id`` and
    ``capacity``, each packed on its own. An item is cut only if it is longer
    than the capacity, into full parts (numbered from 0) and a rest. Items of
    size 0 take no room and are spread over the containers (container 0 if
    there is none). Of a repeated key the row with most tokens counts; null
    keys are left out, null tokens are 0. Windows without a positive capacity
    are left out. No items or no windows give an empty result.
    """
    one = (
        items.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(0)).cast("long")).alias("tokens"))
    )
    pieces = _pieces(one, windows.select("window_id", "capacity").distinct()).withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(SPREAD)))
    pieces = _kept(pieces)
    counted = pieces.groupBy("window_id", "capacity", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    # at most (windows x capacity) rows come to the driver
    histogram: dict[tuple[int, int], dict[int, int]] = {}
    for r in counted.groupBy("window_id", "capacity", "size").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault((r["window_id"], r["capacity"]), {})[r["size"]] = r["n"]
    spark = items.sparkSession
    rows, bins = [], []
    for (window, capacity), counts in histogram.items():
        events, used, _ = plan({s: n for s, n in counts.items() if s > 0}, capacity)
        rows += [(window, *e) for e in events]
        bins.append((window, max(used, 1)))
    events = spark.createDataFrame(rows or [], "window_id int, size long, first_rank long, past_rank long, first_bin long, each long")
    bins = spark.createDataFrame(bins or [], "window_id int, bins long")
    before = Window.partitionBy("window_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("window_id", "size", "salt", "before")
    local = Window.partitionBy("window_id", "size", "salt").orderBy("key", "part")
    ranked = (
        pieces.where(F.col("size") > 0)
        .withColumn("local", F.row_number().over(local) - 1)
        .join(offsets, ["window_id", "size", "salt"])
        .withColumn("rank", F.col("before") + F.col("local"))
    )
    e = events.withColumnRenamed("window_id", "w").withColumnRenamed("size", "s")
    placed = ranked.join(
        F.broadcast(e),  # grows with the capacity, not with the items
        (F.col("window_id") == F.col("w")) & (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("past_rank")),
    ).withColumn("bin", F.col("first_bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each")))
    empty = pieces.where(F.col("size") == 0).join(F.broadcast(bins), "window_id").withColumn("bin", F.pmod(F.xxhash64("key"), F.col("bins")))
    columns = ["window_id", "bin", F.col("key").alias(key), "part", F.col("size").alias("tokens")]
    return placed.select(*columns).unionByName(empty.select(*columns))


def _kept(pieces: DataFrame) -> DataFrame:
    """The pieces are read three times; counting tokens again each time would cost more than writing them."""
    return cut(pieces.select("window_id", "capacity", "key", "part", "size", "salt"))


def room_left(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, n_bins, n_items, tokens, unused, least_bins: containers used, and the fewest that the tokens could need."""
    w = windows.select("window_id", "capacity").distinct()
    return (
        packed.groupBy("window_id", "bin")
        .agg(F.sum("tokens").alias("t"), F.count_if(F.col("part") == 0).alias("i"))
        .groupBy("window_id")
        .agg(F.count_if(F.col("t") > 0).alias("n_bins"), F.sum("i").alias("n_items"), F.sum("t").alias("tokens"))
        .join(F.broadcast(w), "window_id")
        .select(
            "window_id",
            "n_bins",
            "n_items",
            "tokens",
            (F.col("n_bins") * F.col("capacity") - F.col("tokens")).alias("unused"),
            F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"),
        )
    )
