"""Structured Streaming: session decisions with per-user state, windows, late data and sinks by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import THEME_GAP, TIMEOUT

OUTPUT = "user_id long, capture_id long, session long, action string, reason string"
_STATE = "session long, ts long, work_id string, themes array<string>, override string"


def _changed(a: list[str], b: list[str]) -> bool:
    x, y = {t.lower() for t in a}, {t.lower() for t in b}
    return bool(x and y) and len(x & y) / max(len(x), len(y)) < 0.5


def decide(captures: DataFrame, lateness: str = "1 hour", timeout: int = TIMEOUT, theme_gap: int = THEME_GAP) -> DataFrame:
    """Decisions on a stream of captures (user_id, capture_id, ts, work_id, themes, control).

    ``control`` is null, or start or stop: a manual start makes the next capture new, and a stop ends the
    session.  A user's state goes when the watermark passes the last capture by the timeout, so state
    is bounded by active users.  Within a batch captures are taken in order of time and id.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            session = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], None, session, "end", "timeout")], columns=["user_id", "capture_id", "session", "action", "reason"]).astype({"capture_id": "Int64"})
            return
        session, last, work_id, themes, override = state.get if state.exists else (0, None, None, [], None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "capture_id"])
        for r in rows.itertuples():
            now = int(r.ts.timestamp())
            gap = None if last is None else now - last
            if r.control in ("start", "stop"):
                override = r.control
                continue
            if override == "start" or override == "stop":
                action, reason = "new", f"manual_{override}"
            elif gap is None:
                action, reason = "new", "first"
            elif gap > timeout:
                action, reason = "new", "timeout"
            elif r.work_id == work_id:
                action, reason = "continue", "same_source"
            elif _changed(list(themes), list(r.themes)) and gap > theme_gap:
                action, reason = "new", "theme_change"
            else:
                action, reason = "continue", "recent" if gap <= theme_gap else "within_timeout"
            session += action == "new"
            last, work_id, themes, override = now, r.work_id, list(r.themes), None
            out.append((key[0], r.capture_id, session, action, reason))
        state.update((session, last, work_id, list(themes), override))
        if last is not None:
            state.setTimeoutTimestamp(max(last * 1000 + timeout * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "capture_id", "session", "action", "reason"]).astype({"capture_id": "Int64"})

    rows = captures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy("user_id").applyInPandasWithState(work, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(captures: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = "30 minutes") -> DataFrame:
    """Tumbling or sliding counts by work, with late rows let in up to the watermark."""
    rows = captures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "work_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "work_id", "n")


def first_seen(captures: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each capture once, its id being remembered no longer than the watermark."""
    return captures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["capture_id"])


def upsert_batches(stream: DataFrame, table, checkpoint: str):
    """Write a stream to a keyed table, batch by batch; a batch that comes again gives the same table."""
    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(lambda batch, _: table.upsert(batch)).trigger(availableNow=True).start()
