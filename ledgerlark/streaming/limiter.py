"""A sliding-window limiter: rejected requests take no slot, so the state is an ordered recurrence."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, WINDOW_S = 30, 60.0


def accept(times: list[float], taken: deque, limit: int, window: float) -> list[bool]:
    """Whether each request, in order, is accepted; ``taken`` holds the accepted times of the last window."""
    out = []
    for at in times:
        while taken and taken[0] <= at - window:
            taken.popleft()
        ok = len(taken) < limit
        if ok:
            taken.append(at)
        out.append(ok)
    return out


def rate_limit(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """Batch form over (event_id, key, at): adds accepted.

    Rows are sorted by key and time within partitions and streamed in batches:
    a key of any size needs no more memory than its last ``limit`` times.  What
    is accepted depends on all that came before, so one key is one task's work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, taken = None, deque()
        for rows in batches:
            flags = []
            codes = pd.factorize(rows["key"], use_na_sentinel=False)[0]
            runs = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
            for lo, hi in zip(runs, [*runs[1:], len(rows)]):
                if (own := rows["key"].iat[lo]) != key:
                    key, taken = own, deque()
                flags += accept(rows["at"].iloc[lo:hi].tolist(), taken, limit, window)
            rows["accepted"] = flags
            yield rows[["event_id", "accepted"]]

    ordered = requests.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, "event_id long, accepted boolean")


class Limiter(StatefulProcessor):
    """The accepted times of a key's last window, which a timer forgets once the watermark has passed them."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "at double")

    def _keep(self, taken: deque) -> None:
        """Holds these times, and one timer for when the last of them counts no more."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if taken:
            self.taken.put([(x,) for x in taken])
            self.handle.registerTimer(int((taken[-1] + self.window) * 1000) + 1)
        else:
            self.taken.clear()

    def handleInputRows(self, key: object, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        taken = deque(x[0] for x in self.taken.get()) if self.taken.exists() else deque()
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a key's rows of one micro-batch
        own["accepted"] = accept(own["at"].tolist(), taken, self.limit, self.window)
        self._keep(taken)
        yield own[["event_id", "accepted"]]

    def handleExpiredTimer(self, key: object, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._keep(deque())
        return iter(())

    def close(self) -> None:
        pass


#: Timers and lists of state need this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_S, late: str = "10 seconds") -> DataFrame:
    """Streaming form over (event_id, key, at in seconds): the last accepted times of each key are its state.

    A micro-batch's requests are taken in order of time; one that comes more than
    ``late`` behind the newest is dropped.  A key has state only until its window
    has passed.  The session must use the store of ``STATE_STORE``.
    """
    timed = requests.select("event_id", "key", "at", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("when")).withWatermark("when", late)
    return timed.groupBy("key").transformWithStateInPandas(Limiter(limit, window), "event_id long, accepted boolean", "append", "EventTime")
