"""Each decision once in a session until it is reset: the batch form, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.heavy import heavy_keys
from knotwork.session import cut

# Fixed value: the session of events that name none.
DEFAULT_SESSION = "_default"
#: Ranges of seq in which resets are counted; the most files that are heavy, the share of rows from which one is, and the parts of its decisions.
BUCKETS, MOST_HEAVY, HEAVY_SHARE, PARTS = 1024, 64, 0.01, 32


def _placed(events: DataFrame) -> DataFrame:
    """seq, session_id, file, own, epoch of the reads: after how many resets of the session and of all.

    Resets are counted within ranges of seq, and from the sums of the ranges
    before, at most BUCKETS rows for a session; so neither all resets nor all
    events of one session, as of the default one, meet in one task.
    """
    e = events.select("seq", F.coalesce("session_id", F.lit(DEFAULT_SESSION)).alias("session_id"), "op", "file").where(F.col("seq").isNotNull())
    low, high = e.agg(F.min("seq"), F.max("seq")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    e = e.withColumn("bucket", F.floor((F.col("seq") - F.lit(low or 0)) / width)).withColumn("all", (F.col("op") == "reset_all").cast("long")).withColumn("mine", F.col("op").isin("clear", "end").cast("long"))
    before = (Window.unboundedPreceding, -1)
    per_all = e.groupBy("bucket").agg(F.sum("all").alias("n"))
    base_all = per_all.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("all_before"))  # at most BUCKETS rows
    per_own = e.groupBy("session_id", "bucket").agg(F.sum("mine").alias("n"))
    base_own = per_own.select("session_id", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("own_before"))
    here = (Window.unboundedPreceding, 0)
    counted = e.withColumn("all_here", F.sum("all").over(Window.partitionBy("bucket").orderBy("seq").rowsBetween(*here))).withColumn("own_here", F.sum("mine").over(Window.partitionBy("session_id", "bucket").orderBy("seq").rowsBetween(*here)))
    reads = counted.where((F.col("op") == "read") & F.col("file").isNotNull())
    return (
        reads.join(base_own, ["session_id", "bucket"])
        .join(F.broadcast(base_all), "bucket")
        .select("seq", "session_id", "file", (F.col("own_before") + F.col("own_here")).alias("own"), (F.col("all_before") + F.col("all_here")).alias("epoch"))
    )


def _of_file(reads: DataFrame, other: DataFrame, heavy: list, parts: int) -> DataFrame:
    """reads joined with other by file. Rows of heavy files in other are dealt to parts, and the reads of such files go to each."""
    hot = F.col("file").isin(heavy) if heavy else F.lit(False)
    part = F.pmod(F.xxhash64(*[c for c in other.columns if c != "file"]), F.lit(parts)).cast("int")
    left = reads.withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    right = other.withColumn("part", F.when(hot, part).otherwise(0))
    return left.join(right, ["file", "part"]).drop("part")


def new_decisions(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq, session_id, file, decision_id: each decision with the read that shows it first in its epoch.

    events: seq, session_id, op (read, clear, end, reset_all), file; pairs:
    distinct (decision_id, file). ``clear`` and ``end`` reset their session,
    ``reset_all`` all. A null session is the default one; events without seq,
    reads without a file and pairs without a file are no cases. Only the first
    read of a file in an epoch can show something new, so reads are reduced to
    those before they meet decisions.
    """
    return _new(_placed(events), pairs)


def _new(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    first = placed.groupBy("session_id", "own", "epoch", "file").agg(F.min("seq").alias("seq"))
    pairs = pairs.where(F.col("file").isNotNull()).select("decision_id", "file")
    met = _of_file(first, pairs, heavy_keys(pairs, "file", MOST_HEAVY, HEAVY_SHARE), PARTS)
    shown = met.groupBy("session_id", "own", "epoch", "decision_id").agg(F.min(F.struct("seq", "file")).alias("r"))
    return shown.select("r.seq", "session_id", "r.file", "decision_id")


def _summary(placed: DataFrame, pairs: DataFrame, new: DataFrame) -> DataFrame:
    total = pairs.where(F.col("file").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    hot = heavy_keys(placed, "file", MOST_HEAVY, HEAVY_SHARE)
    is_hot = F.col("file").isin(hot) if hot else F.lit(False)
    met = placed.where(~is_hot).join(total.where(~is_hot), "file").unionByName(placed.where(is_hot).join(F.broadcast(total.where(is_hot)), "file"))  # at most MOST_HEAVY rows
    fresh = new.groupBy("seq").agg(F.count(F.lit(1)).alias("new_cnt"))
    return met.join(fresh, "seq", "left").select("seq", "session_id", "file", "total", F.coalesce("new_cnt", F.lit(0)).alias("new_cnt"))


def read_summary(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq, session_id, file, total, new_cnt of every read of a file with decisions; no read is multiplied by them."""
    placed = _placed(events)
    return _summary(placed, pairs, _new(placed, pairs))


def served(events: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_summary and new_decisions, made once."""
    placed = cut(_placed(events))
    new = cut(_new(placed, pairs))
    return _summary(placed, pairs, new), new


def read_decisions(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq, session_id, file, decision_id, is_new: every decision that a read meets."""
    placed = _placed(events)
    pairs = pairs.where(F.col("file").isNotNull()).select("decision_id", "file")
    new = _new(placed, pairs).select("seq", "decision_id", F.lit(True).alias("is_new"))
    met = _of_file(placed, pairs, heavy_keys(pairs, "file", MOST_HEAVY, HEAVY_SHARE), PARTS)
    return met.join(new, ["seq", "decision_id"], "left").select("seq", "session_id", "file", "decision_id", F.coalesce("is_new", F.lit(False)).alias("is_new"))


def final_state(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """session_id, decision_id: what each session has been shown since its last reset."""
    e = events.withColumn("session_id", F.coalesce("session_id", F.lit(DEFAULT_SESSION)))
    all_reset = e.where(F.col("op") == "reset_all").agg(F.coalesce(F.max("seq"), F.lit(-(2**62))).alias("all_seq"))
    last = e.where(F.col("op").isin("clear", "end")).groupBy("session_id").agg(F.max("seq").alias("own_seq"))
    reads = e.where(F.col("op") == "read").join(last, "session_id", "left").crossJoin(F.broadcast(all_reset))
    live = reads.where((F.col("seq") > F.coalesce("own_seq", F.lit(-(2**62)))) & (F.col("seq") > F.col("all_seq")))
    pairs = pairs.where(F.col("file").isNotNull()).select("decision_id", "file")
    met = _of_file(live.where(F.col("file").isNotNull()).select("session_id", "file").distinct(), pairs, heavy_keys(pairs, "file", MOST_HEAVY, HEAVY_SHARE), PARTS)
    return met.select("session_id", "decision_id").distinct()


def collected_sessions(states: DataFrame, ended: DataFrame, now, days: int = 7) -> DataFrame:
    """states (session_id, modified_at, ...) without ended sessions and without those older than the days (strictly)."""
    kept = states.join(ended.select("session_id").distinct(), "session_id", "left_anti")
    return kept.where(F.col("modified_at") >= F.lit(now) - F.expr(f"interval {int(days)} days"))


def session_states(events: DataFrame, pairs: DataFrame, time: str = "modified_at") -> DataFrame:
    """session_id, modified_at, shown_decision_ids: one row for each session that has a state after the events.

    events has its time in the column named. A read that meets decisions makes
    a state or adds to it, ``clear`` empties one (or makes an empty one),
    ``end`` removes it, ``reset_all`` empties those there are. modified_at is the time of the
    last event that wrote the state. Events without a session are of the default one.
    """
    e = events.where(F.col("seq").isNotNull()).select("seq", F.coalesce("session_id", F.lit(DEFAULT_SESSION)).alias("session_id"), "op", "file", F.col(time).alias("at"))
    files = pairs.where(F.col("file").isNotNull()).select("file").distinct()
    reads = e.where(F.col("op") == "read").join(files, "file", "left_semi").select("session_id", "seq", "at", "op")
    own = reads.unionByName(e.where(F.col("op").isin("clear", "end")).select("session_id", "seq", "at", "op"))
    per = own.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(F.col("op") == "end", F.col("seq"))), F.lit(-(2**62))).alias("ended"),
        F.max(F.when(F.col("op") != "end", F.struct("seq", "at"))).alias("last"),
    ).where(F.col("last.seq") > F.col("ended"))
    # a reset of all sessions writes the states that are there when it comes
    first = own.where(F.col("op") != "end").join(per.select("session_id", "ended"), "session_id").where(F.col("seq") > F.col("ended")).groupBy("session_id").agg(F.min("seq").alias("born"))
    reset = e.where(F.col("op") == "reset_all").agg(F.max(F.struct("seq", "at")).alias("reset"))
    kept = per.join(first, "session_id").crossJoin(F.broadcast(reset))
    wrote = F.when((F.col("reset.seq") > F.col("last.seq")) & (F.col("reset.seq") > F.col("born")), F.col("reset.at")).otherwise(F.col("last.at"))
    shown = final_state(events, pairs).groupBy("session_id").agg(F.array_sort(F.collect_set("decision_id")).alias("ids"))
    empty = F.array().cast("array<long>")
    return kept.join(shown, "session_id", "left").select("session_id", wrote.alias("modified_at"), F.coalesce("ids", empty).alias("shown_decision_ids"))


def read_shown(states: DataFrame, session_id: str | None) -> DataFrame:
    """decision_id of what the session has been shown; none for a session without a state."""
    mine = states.where(F.col("session_id") == (DEFAULT_SESSION if session_id is None else session_id))
    return mine.select(F.explode("shown_decision_ids").alias("decision_id")).distinct()


def write_shown(states: DataFrame, written: DataFrame, now) -> DataFrame:
    """states with those of written (session_id, shown_decision_ids) in place of the former ones."""
    w = written.select(F.coalesce("session_id", F.lit(DEFAULT_SESSION)).alias("session_id"), F.lit(now).cast("timestamp").alias("modified_at"), "shown_decision_ids")
    return states.select(*w.columns).join(w.select("session_id").distinct(), "session_id", "left_anti").unionByName(w)


def wiped(states: DataFrame, now) -> DataFrame:
    """All states, empty."""
    return states.select("session_id", F.lit(now).cast("timestamp").alias("modified_at"), F.array().cast("array<long>").alias("shown_decision_ids"))


def reset_message(states: DataFrame) -> DataFrame:
    """One row, text: how many states a reset of all sessions wipes."""
    n = F.count(F.lit(1))
    return states.agg(F.concat(F.lit("decision cache reset ("), n.cast("string"), F.lit(" session file"), F.when(n == 1, "").otherwise("s"), F.lit(" wiped)")).alias("text"))


def state_path(root: str, session_id: str | None) -> str:
    """Where the state of a session lies below a root."""
    return f"{root.rstrip('/')}/sessions/session_id={DEFAULT_SESSION if session_id is None else session_id}"
