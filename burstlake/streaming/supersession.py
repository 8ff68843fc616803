"""Newest request wins, over a stream: keyed state of one number and one time, which ends when a key has been idle.

A request of a session's client replaces the one before if its generation is higher.  Rows of a key are taken in order of time and
generation; each gives one row, and so does what it replaces:

* accepted    the newest so far; work on it may go on
* superseded  a newer one has come (``replaced_by``); work on it stops
* repeated    the newest one again
* stale       older than the newest

After ``idle_seconds`` without a request a client is forgotten (expired, with its last generation) and may start from any
generation.  That is decided by event time: by the gap when the next request comes, by a timer when the watermark passes otherwise.
So results don't depend on how rows are cut into micro-batches, as long as no row comes later than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_SECONDS = 300
OUTPUT = "session string, client string, generation long, status string, replaced_by long, at_us long"
RESULT = Row("session", "client", "generation", "status", "replaced_by", "at_us")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Supersession(StatefulProcessor):
    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "generation long, last_us long")

    # Keys are many and have few rows each: rows come one by one, not as a table for each key, and each call for state is a round trip.
    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.newest.get()
        newest, last = (known[0], known[1]) if known else (None, None)
        out: list[tuple] = []
        # The rows of one key in one micro-batch: two numbers each.
        batch = sorted((r["at_us"], r["generation"]) for r in rows)
        for us, generation in batch:
            if last is not None and us - last > self.idle_us:
                out.append((*key, newest, "expired", None, last + self.idle_us))
                newest = None
            if newest is None or generation > newest:
                if newest is not None:
                    out.append((*key, newest, "superseded", generation, us))
                newest = generation
                out.append((*key, generation, "accepted", None, us))
            else:
                out.append((*key, generation, "repeated" if generation == newest else "stale", None, us))
            last = us if last is None else max(last, us)
        if known:  # a key without state has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.idle_us) // 1000) + 1)
        self.newest.update((newest, last))
        yield from (RESULT(*o) for o in out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        known = self.newest.get()
        if known:
            self.newest.clear()
            yield RESULT(*key, known[0], "expired", None, known[1] + self.idle_us)

    def close(self) -> None:
        pass


def supersession_stream(requests: DataFrame, watermark: str = "0 seconds", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """requests: a stream of (session string, client string, generation long, at timestamp)."""
    from pyspark.sql import functions as F

    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the only one that keeps several kinds of state and timers
    rows = requests.withWatermark("at", watermark).withColumn("at_us", F.unix_micros("at"))
    return rows.groupBy("session", "client").transformWithState(Supersession(idle_seconds * 1_000_000), OUTPUT, "Append", "eventTime")
