"""Reading sessions: boundary rules in batch, summaries, threads and re-reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT, THEME_GAP = 3600, 1800


def theme_changed(a: Column, b: Column) -> Column:
    """Less than half of the larger list in common, case aside; false if one is empty."""
    low = [F.transform(x, lambda t: F.lower(t)) for x in (a, b)]
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(*low)) / F.greatest(F.size(a), F.size(b)) < 0.5)


def decided(captures: DataFrame, timeout: int = TIMEOUT, theme_gap: int = THEME_GAP) -> DataFrame:
    """Add action, reason, confidence and session to captures (user_id, capture_id, ts, work_id, themes).

    In this order: first capture; a gap above the timeout is new; the same work goes on; changed themes
    after more than ``theme_gap`` are new; another work goes on, the surer the shorter the gap.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "capture_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    c = captures.withColumns({"gap": gap, "_work": F.lag("work_id").over(w), "_themes": F.lag("themes").over(w)})
    rules = (
        (F.col("gap").isNull(), "new", "first", 1.0), (F.col("gap") > timeout, "new", "timeout", 0.95), (F.col("_work") == F.col("work_id"), "continue", "same_source", 0.95),
        (theme_changed(F.col("_themes"), F.col("themes")) & (F.col("gap") > theme_gap), "new", "theme_change", 0.85), (F.col("gap") <= theme_gap, "continue", "recent", 0.8), (F.lit(True), "continue", "within_timeout", 0.6),
    )
    picked = [None, None, None]
    for rule in rules:
        for i, value in enumerate(rule[1:]):
            picked[i] = F.when(rule[0], F.lit(value)) if picked[i] is None else picked[i].when(rule[0], F.lit(value))
    c = c.withColumns({"action": picked[0], "reason": picked[1], "confidence": picked[2]})
    return c.withColumn("session", F.sum((F.col("action") == "new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_work", "_themes")


def summaries(sessions: DataFrame) -> DataFrame:
    """user_id, session, captures, sources, minutes and pick-up point (work of the last capture)."""
    last = F.max_by("work_id", F.struct("ts", "capture_id"))
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return sessions.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("captures"), F.countDistinct("work_id").alias("sources"), F.floor(seconds / 60).alias("minutes"), last.alias("pick_up"))


def theme_threads(sessions: DataFrame, n: int = 3) -> DataFrame:
    """user_id, session, theme, earlier: for each theme the ``n`` latest sessions before with it."""
    t = sessions.select("user_id", "session", F.explode("themes").alias("theme")).distinct()
    w = Window.partitionBy("user_id", "theme").orderBy("session").rowsBetween(-n, -1)
    return t.withColumn("earlier", F.collect_list("session").over(w)).filter(F.size("earlier") > 0)
