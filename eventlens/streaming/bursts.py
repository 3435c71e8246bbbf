"""Codes that users of a stream repeat within a short time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import BURST_EVENTS, BURST_SECONDS

WINDOW = "uid string, code string, start_us long, events long, span_us long"
#: Slices that users' codes are dealt to; each is a key of the state.
SLICES = 1024


def _packed(events: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(events, pa.schema([("uid", pa.string()), ("code", pa.string()), ("us", pa.int64())]), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Bursts(StatefulProcessor):
    """Keeps the times of a slice's users and codes until no window that is
    still open begins at them.

    A window begins at each different time and holds what follows within its
    length, of one user's code. It is told once the watermark has passed its
    end, when nothing can join it any more; then its time is dropped. A timer
    waits for the end of the slice's earliest open window, one at a time. What
    a batch brings is one entry of the state, so calls to the state follow the
    slices and not the users.
    """

    def __init__(self, window_seconds: float, min_events: int) -> None:
        self.window, self.least = int(window_seconds * 1_000_000), min_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "part binary")

    def _wait(self, first: int) -> None:
        """Wait for the end of the window that begins at ``first``, if it is the earliest."""
        end, timers = -(-(first + self.window) // 1000), list(self.handle.listTimers())
        if not timers or end < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([batch[["uid", "code", "us"]] for batch in rows])
        self.held.appendValue((_packed(new),))
        self._wait(int(new["us"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.concat([pa.ipc.open_stream(bytes(part[0])).read_pandas() for part in self.held.get()], ignore_index=True)
        of = held.groupby(["uid", "code"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((held["us"].to_numpy(np.int64), of))
        held, of = held.iloc[order], of[order]
        us, passed = held["us"].to_numpy(np.int64), timerValues.getCurrentWatermarkInMs() * 1000
        done = us + self.window <= passed
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(us)]
        at, events, spans = [], [], []
        for begin, end in itertools.pairwise(cuts):
            times = us[begin:end]
            starts = np.unique(times[done[begin:end]])
            first, last = np.searchsorted(times, starts), np.searchsorted(times, starts + self.window, "right")
            told = last - first >= self.least
            at.append(begin + first[told])
            events.append((last - first)[told])
            spans.append(times[last[told] - 1] - starts[told])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if done.all():
            self.held.clear()
        else:
            self.held.put([(_packed(held[~done]),)])
            self._wait(int(us[~done].min()))
        at = np.concatenate(at)
        if len(at):
            yield pd.DataFrame({"uid": held["uid"].to_numpy()[at], "code": held["code"].to_numpy()[at], "start_us": us[at],
                                "events": np.concatenate(events), "span_us": np.concatenate(spans)})

    def close(self) -> None:
        pass


def burst_stream(events: DataFrame, window_seconds: float = BURST_SECONDS, min_events: int = BURST_EVENTS, late: str = "10 minutes",
                 slices: int = SLICES) -> DataFrame:
    """A row for each window of (uid, code, ts) with enough events, once it
    can't change any more: uid, code, start, events, span_seconds.

    Events without a time begin no window. Those that come later than the
    watermark allows are dropped by Spark, as in any stream. Users' codes are
    dealt to ``slices``, whose number a stream keeps for its life; the state of
    one is as large as its events within a window and the delay, and is read
    whole when a window of it ends.
    """
    timed = events.where("ts is not null").select("uid", "code", F.col("ts").cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at"))
    dealt = timed.withColumn("slice", F.pmod(F.xxhash64("uid", "code"), F.lit(slices)))
    found = dealt.withWatermark("at", late).groupBy("slice").transformWithStateInPandas(
        Bursts(window_seconds, min_events), outputStructType=WINDOW, outputMode="Append", timeMode="EventTime")
    return found.select("uid", "code", F.timestamp_micros("start_us").alias("start"), "events", (F.col("span_us") / 1_000_000).alias("span_seconds"))
