"""The batch state machines as streams: documents' manifests by key, and event windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "code string, kind string, file string, effective string, first_seen string, prev_file string"
_STATE = "file string, effective string, sha string, first_seen string, prev_file string"


def transition(state: tuple | None, file: str, effective: str, sha: str | None, seen: str, failed: bool) -> tuple[str, tuple | None]:
    """Kind of event and the next state, by the same rules as the batch comparison of manifests."""
    if failed:
        return ("fetch_stale", state) if state else ("fetch_failed", None)
    if state is None:
        return "new", (file, effective, sha, seen, None)
    old_file, old_effective, old_sha, first_seen, prev = state
    if effective < old_effective:
        return "unchanged", state
    if file != old_file:
        return "revised", (file, effective, sha, seen, old_file)
    if sha != old_sha:
        return "silent_edit", (file, effective, sha, first_seen, prev)
    return "unchanged", state


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(None if v is None or v != v else v for v in state.get) if state.exists else None
    out = []
    rows = pd.concat(list(frames)).sort_values(["seen", "ordinal"])
    for r in rows.itertuples():
        kind, now = transition(now, r.file, r.effective, r.sha, r.seen, bool(r.failed))
        if kind != "unchanged":
            out.append((key[0], kind, *((now[0], now[1], now[3], now[4]) if now else (None,) * 4)))
    if now is not None:
        state.update(now)
    yield pd.DataFrame(out, columns=["code", "kind", "file", "effective", "first_seen", "prev_file"])


def manifest_events(fetches: DataFrame) -> DataFrame:
    """Stream of fetches (code, file, effective, sha, seen, ordinal, failed) -> stream of events; a code's state is its manifest row."""
    return fetches.groupBy("code").applyInPandasWithState(_update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; events later than `late` are dropped by the watermark when streaming."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = t.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
