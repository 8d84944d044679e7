"""The manifest of fetched rule files as a stream with state: a row per code, its history, and a timer that says when it was last looked at too long ago.

State per code: `manifest`, one row by the rules of the batch comparison, with the day
of the last look; `history`, a list of what happened; and one timer, moved with every
look, that fires when event time has passed the last look by so many days. State and
timers survive a restart from the checkpoint, and `manifest_rows` and `history_rows` read
them from there as tables.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import manifest
from .manifest import transition

OUT = "code string, kind string, file string, effective string, first_seen string, prev_file string, last_verified timestamp, n_events int"
_EVENT = Row(*(c.split()[0] for c in OUT.split(", ")))
_MANIFEST = "file string, effective string, sha string, first_seen string, prev_file string, verified_ms long, n_events int"
_HISTORY = "kind string, seen string, file string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class ManifestWatch(StatefulProcessor):
    """fetches (code, file, effective, sha, seen, ordinal, failed, at, at_ms) -> events; `at` is the event time, `at_ms` the same in milliseconds.

    Rows, not frames: a code has few fetches in a batch, and a frame for each would cost
    more than all else. Every call on the state goes to the JVM and back, so there is one
    for what is read and one for each state that changes.
    """

    def __init__(self, stale_days: int):
        self.stale_ms = stale_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.manifest = handle.getValueState("manifest", _MANIFEST)
        self.history = handle.getListState("history", _HISTORY)

    def _row(self, code: str, kind: str, state: tuple | None, verified: int | None, n: int) -> Row:
        shown = (state[0], state[1], state[3], state[4]) if state else (None,) * 4
        return _EVENT(code, kind, *shown, None if verified is None else datetime.fromtimestamp(verified / 1000, timezone.utc), n)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = verified = None
        n, happened, out = 0, [], []
        known = self.manifest.get()
        if known is not None:
            *kept, verified, n = known
            state = tuple(kept)
        before = verified
        for r in sorted(rows, key=lambda r: (r["at"], r["ordinal"])):
            kind, state = transition(state, r["file"], r["effective"], r["sha"], r["seen"], bool(r["failed"]))
            if state is not None:  # whatever came of it, the code was looked at
                verified = r["at_ms"]
            if kind != "unchanged":
                n += 1
                happened.append((kind, r["seen"], r["file"]))
                out.append(self._row(key[0], kind, state, verified, n))
        if happened:
            self.history.appendList(happened)
        if state is not None:
            if before is not None:
                self.handle.deleteTimer(before + self.stale_ms)
            self.handle.registerTimer(verified + self.stale_ms)
            self.manifest.update((*state, verified, n))
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        *kept, verified, n = self.manifest.get()
        self.history.appendValue(("stale", None, kept[0]))
        self.manifest.update((*kept, verified, n + 1))
        yield self._row(key[0], "stale", tuple(kept), verified, n + 1)

    def close(self) -> None:
        pass


def manifest_watch(fetches: DataFrame, stale_days: int = 30, late: str = "0 seconds") -> DataFrame:
    """Stream of fetches -> stream of events: new, revised, silent_edit, fetch_failed, fetch_stale, and stale when a code has not been looked at for `stale_days`.

    The session's state store has to be PROVIDER. A fetch later than `late` behind the newest is dropped by the watermark.
    """
    for module in (manifest, sys.modules[__name__]):  # the driver's own worker for stateful processors does not see files that were added for executors
        cloudpickle.register_pickle_by_value(module)
    return fetches.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late).groupBy("code").transformWithState(ManifestWatch(stale_days), OUT, "Append", "EventTime")


def manifest_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The manifest as the last batch left it, read from the stream's state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "manifest").load()
    return state.selectExpr("key.code AS code", "value.file", "value.effective", "value.first_seen", "value.prev_file", "timestamp_millis(value.verified_ms) AS last_verified", "value.n_events")


def history_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """code, kind, seen, file: a row for every event that the state remembers."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "history").option("flattenCollectionTypes", "true").load()
    return state.selectExpr("key.code AS code", "list_element.kind", "list_element.seen", "list_element.file")
