"""The shown-once state machine on a stream, one state for each session."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knotwork.operators.sessions import DEFAULT_SESSION
from knotwork.session import ship

OUT = "seq long, session_id string, decision_id long, is_new boolean"
STATE = "shown array<long>, epoch long"
#: A session without events for so long is forgotten.
KEPT_MS = 7 * 24 * 3600 * 1000


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    shown, epoch = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
    out = []
    rows = pd.concat(list(batches))
    for r in rows.sort_values(["seq", "decision_id"], na_position="first").itertuples(index=False):
        if r.epoch > epoch:  # a reset of all sessions came in between
            shown, epoch = set(), r.epoch
        if r.op in ("clear", "end"):
            shown = set()
        elif r.op == "read" and not pd.isna(r.decision_id):
            d = int(r.decision_id)
            out.append((r.seq, key[0], d, d not in shown))
            shown.add(d)
    if shown or epoch:
        state.update((sorted(shown), int(epoch)))
        if forget:
            state.setTimeoutDuration(KEPT_MS)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["seq", "session_id", "decision_id", "is_new"])


def shown_once(events: DataFrame, pairs: DataFrame, forget: bool = True) -> DataFrame:
    """seq, session_id, decision_id, is_new of a stream of events.

    events: seq, session_id, op, file, epoch. epoch counts the resets of all
    sessions before the event; a source has it, as no state is shared by
    sessions. pairs: a static table of distinct (decision_id, file). With
    forget, sessions idle for KEPT_MS lose their state; such a query runs until
    it is stopped, as its clock goes on without input.
    """
    from pyspark.sql import functions as F

    ship(events.sparkSession)
    e = events.withColumn("session_id", F.coalesce("session_id", F.lit(DEFAULT_SESSION)))
    met = e.join(pairs, "file", "left").select("session_id", "seq", "op", "decision_id", "epoch")
    return met.groupBy("session_id").applyInPandasWithState(partial(_step, forget=forget), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
