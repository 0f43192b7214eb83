"""Raw segments from a stream of labelled windows.

The batch fold needs the window before and the window after; a stream keeps, for each file, the open
segment and the last window's end, and gives a segment once a window of it no longer can change:
when the next segment has begun. Ten minutes without news close a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "file_id long, speaker string, start double, end double"
QUIET_MS = 600_000
STATE = "speaker string, start double, end double, idx long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, quiet_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Windows of one file, in order of idx; those at or before the last one seen are repeats and ignored."""
    out: list[tuple] = []
    held = state.get if state.exists else None
    if state.hasTimedOut:
        state.remove()
        if held:
            out.append((key[0], held[0], held[1], held[2]))
        yield pd.DataFrame(out, columns=["file_id", "speaker", "start", "end"])
        return
    rows = pd.concat(list(batches)).sort_values("idx")
    for w in rows.itertuples():
        a, b = max(0.0, w.start), max(0.0, w.end)
        if held is None:
            held = (w.speaker, a, b, int(w.idx))
            continue
        speaker, start, end, idx = held
        if w.idx <= idx:
            continue
        if w.speaker == speaker and a <= end:
            held = (speaker, start, b, int(w.idx))
            continue
        if w.speaker != speaker and a < end:
            end = a = max(0.0, (end + a) / 2)
        out.append((key[0], speaker, start, end))
        held = (w.speaker, a, b, int(w.idx))
    state.update(held)
    if quiet_ms is not None:
        state.setTimeoutDuration(quiet_ms)
    yield pd.DataFrame(out, columns=["file_id", "speaker", "start", "end"])


def stream_segments(windows: DataFrame, quiet_ms: int | None = QUIET_MS) -> DataFrame:
    """Segments of a stream of (file_id, idx, speaker, start, end). The last segment of a file stays
    open until `quiet_ms` of processing time without news close it (None: for good)."""
    timeout = GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(key, batches, state):
        return fold(key, batches, state, quiet_ms)

    return windows.groupBy("file_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def windowed_speaking_time(turns: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Speaking time by speaker and event-time window of a stream of (ts, speaker, start, end);
    rows later than `late` are dropped, as a watermark does."""
    from pyspark.sql import functions as F

    return turns.withWatermark("ts", late).groupBy(F.window("ts", width), "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
