"""Windowed aggregates over event streams; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import best_matches, scored_candidates


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_means(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.window(ts, size, slide)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's events with less than the gap between them; a session ends the gap after its last event."""
    g = _marked(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def matched_stream(frames: DataFrame, buildings: DataFrame) -> DataFrame:
    """Each streamed frame with its scored candidates: a stream joined with a static table."""
    return scored_candidates(frames, buildings)


def dashboard_stream(selected: DataFrame, calibrated: DataFrame, late: str = "10 minutes", within: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """selected with each frame's calibrated error and whether it is an inlier, where one comes within so long before or after it: both are streams (or both tables) with a time.

    A frame without one is given out, with nulls, when the watermark has passed the time in which one could come; until then both sides are held, and no longer. Rows later than the watermark are dropped and counted (late_rows).
    """
    c = calibrated.select(F.col("frame_id").alias("_frame"), F.col(ts).alias("_at"), "calibrated_error_m", "is_inlier")
    near = (F.col("frame_id") == F.col("_frame")) & (F.col("_at") >= F.col(ts) - F.expr(f"INTERVAL {within}")) & (F.col("_at") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return _marked(selected, ts, late).join(_marked(c, "_at", late), near, "left").drop("_frame", "_at")


def late_rows(query) -> int:
    """How many rows a streaming query has dropped because they came later than its watermark, in the triggers that it still remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def write_matches(frames: DataFrame, buildings: DataFrame, path: str, checkpoint: str):
    """A query that appends each trigger's best matches; a trigger that is run again writes its own folder again."""

    def put(batch: DataFrame, n: int) -> None:
        best_matches(batch, buildings).write.mode("overwrite").parquet(f"{path}/trigger={n}")

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
