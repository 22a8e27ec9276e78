"""Streams of log events: an addition to the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "2 hours", ts: str = "ts", key: str = "log_id") -> DataFrame:
    """(key, start, end, events) of stretches without a gap, once no late event can change them."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(key)).agg(F.count("*").alias("events"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def type_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts of event kinds in tumbling or sliding windows."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), F.col(kind)).agg(F.count("*").alias("count"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "count")


def app_runs(events: DataFrame, app: str = "event_type", key: str = "log_id", index: str = "event_index", ts: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, app, start_index, end_index, length) of finished runs of one application, events of a key coming in order.

    The state of a key is its open run; it is put out when the application changes. With ts, a key that has had no event for idle_ms of event time
    is over once the watermark, `late` behind the latest event, has passed that: its last run is put out and its state goes. Without
    ts states stay for as long as the stream runs."""
    kind = dict(events.dtypes)[key]
    out = f"{key} {kind}, app string, start_index long, end_index long, length long"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        done, latest = [], 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], *open_)], columns=[key, "app", "start_index", "end_index", "length"])
            return
        for batch in batches:
            for name, i in batch.sort_values(index)[[app, index]].itertuples(index=False):
                if open_ is None or open_[0] != name:
                    if open_ is not None:
                        done.append((k[0], *open_))
                    open_ = (name, int(i), int(i), 1)
                else:
                    open_ = (name, open_[1], int(i), open_[3] + 1)
            if ts is not None:
                latest = max(latest, int(batch[ts].max().timestamp() * 1000))
        if open_ is not None:
            state.update(open_)
            if ts is not None:
                state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "app", "start_index", "end_index", "length"])

    rows = events if ts is None else events.withWatermark(ts, late)
    timeout = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, "app string, start_index long, end_index long, length long", "append", timeout)
