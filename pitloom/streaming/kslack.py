"""The late-event operator on a stream, and upserts of a stream into a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.late import aggregate_released, period_and_close

OUT = "kind string, period_day int, buffer int, record_id long, event_us long, as_of_us long, n long, first_us long, last_us long"
STATE = "ids array<bigint>, times array<bigint>, arrivals array<bigint>"
ORDER = ["as_of_us", "event_us"]


def _rows(kind: str, day: int, buffer: int, rows: pd.DataFrame | None = None, **values) -> pd.DataFrame:
    names = [x.split()[0] for x in OUT.split(", ")]
    out = rows.reset_index(drop=True) if rows is not None else pd.DataFrame(index=[0])
    out = out.assign(kind=kind, period_day=day, buffer=buffer, **values)
    for c in names[3:]:
        out[c] = out[c].astype("Int64") if c in out else pd.array([None] * len(out), dtype="Int64")
    return out[names]


def k_slack_stream(events: DataFrame, record_id: str, event_ts: str, as_of_ts: str, slack_hours: int, delay: str | None = None, buffers: int = 16, period: str = "day") -> DataFrame:
    """Buffers the events of each period until its close (end plus slack), and releases them then, in the order of event time.

    Rows by `kind`: `released`, one row an event when the watermark of the arrival times passes the close; `late`, an
    arrival behind the close; `provisional`, for each buffer of a period that has grown: the number of events it holds (n) and their first and
    last time. A period is spread over `buffers` states by record, which are released in the same micro-batch, so a
    period's final values are aggregate_released over the released rows of a batch (see `finals`). A record that arrives again in
    time replaces its earlier arrival, whichever of them the stream delivers first.

    delay: how much later than newer ones an arrival may be delivered; what comes later still is dropped by Spark's watermark.
    It is the slack if it isn't given; a period is released so much behind its close. Rows with a NULL in either time are
    dropped. The state of a released period is removed.
    """
    start, close = period_and_close(F.col(event_ts), period, slack_hours)
    rows = events.filter(F.col(event_ts).isNotNull() & F.col(as_of_ts).isNotNull()).withWatermark(as_of_ts, delay or f"{slack_hours} hours")
    rows = rows.select(start.alias("period_day"), close.alias("close_us"), F.pmod(F.xxhash64(record_id), F.lit(buffers)).cast("int").alias("buffer"), F.col(record_id).cast("long").alias("record_id"), F.unix_micros(event_ts).alias("event_us"), F.unix_micros(as_of_ts).alias("as_of_us"), as_of_ts)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, buffer, close_us = int(key[0]), int(key[1]), int(key[2])
        held = pd.DataFrame(dict(zip(("record_id", "event_us", "as_of_us"), map(np.asarray, state.get)))) if state.exists else None
        if not state.hasTimedOut:
            new = pd.concat([b[["record_id", "event_us", "as_of_us"]] for b in batches])
            late = new[new["as_of_us"] > close_us]
            if len(late):
                yield _rows("late", day, buffer, late)
            new = new[new["as_of_us"] <= close_us]
            if not len(new):
                return
            held = pd.concat([held, new]) if held is not None else new
            held = held.sort_values(ORDER, kind="stable").drop_duplicates("record_id", keep="last")
            if close_us // 1000 + 1 > state.getCurrentWatermarkMs():
                state.update(tuple(held[c].tolist() for c in ("record_id", "event_us", "as_of_us")))
                state.setTimeoutTimestamp(close_us // 1000 + 1)
                yield _rows("provisional", day, buffer, n=len(held), first_us=int(held["event_us"].min()), last_us=int(held["event_us"].max()))
                return
        if state.exists:
            state.remove()
        yield _rows("released", day, buffer, held.sort_values(["event_us", "record_id"]))

    return rows.groupBy("period_day", "buffer", "close_us").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def finals(out: DataFrame) -> DataFrame:
    """Final values of the periods that a micro-batch (or the whole output) of k_slack_stream releases."""
    return aggregate_released(out.filter("kind = 'released'").select("period_day", "record_id", "event_us"))


def into_store(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], object]):
    """Runs a stream over what is there and hands each micro-batch to `write`, which must be idempotent (an upsert)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
