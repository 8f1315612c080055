"""Time series: unwrapped headings and poses interpolated to frame times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Frames
from ..functions.basic import mod
from ..shared import cut
from . import scan


def _turned(step: Column) -> Column:
    """What is to be added from a step on so that it has no jump."""
    wrapped = mod(step + 180, 360) - 180
    wrapped = F.when((wrapped == -180) & (step > 0), 180.0).otherwise(wrapped)
    return F.coalesce(F.when(F.abs(step) < 180, 0.0).otherwise(wrapped - step), F.lit(0.0))


def unwrapped(samples: DataFrame, value: str, out: str, by: str = "drive_id", order: tuple[str, ...] = ("t",), ranges: int | None = None) -> DataFrame:
    """samples with out: value in degrees without jumps. A step of 180 or more is corrected by whole turns; a step of exactly half a turn keeps its direction.

    A drive may be of any length: each piece of it is unwrapped alone, and the corrections before it, and the step into it, come from the pieces' totals. Null values have no step; rows of one time
    follow in any way but for further columns in order. samples are gone through twice, for the ranges and for the pieces.
    """
    p = scan.pieces(samples, by, order, ranges)
    w = scan.inside(by)
    p = p.withColumn("_fix", F.sum(_turned(F.col(value) - F.lag(value).over(w))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    t = scan.totals(p, by, _first=scan.first(value), _last=scan.last(value), _sum=scan.last("_fix"))
    a = scan.along(by)
    t = t.withColumn("_into", _turned(F.col("_first") - F.lag("_last").over(a)))
    t = t.withColumn("_carry", F.sum(F.col("_into") + F.coalesce(F.lag("_sum").over(a), F.lit(0.0))).over(a.rowsBetween(W.unboundedPreceding, 0)))
    return scan.carried(p, t, by, "_carry").withColumn(out, F.col(value) + F.col("_carry") + F.col("_fix")).drop("_fix", "_carry", scan.PIECE, scan.PLACE)


def segments(samples: DataFrame, values: tuple[str, ...], by: str = "drive_id", t: str = "t", tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """Between each sample and the next: t0, t1 and each value's v0 and v1, and whether the segment is the last. Of samples at one time the first (by tie) counts. The last sample of a piece of a drive finds the next one in the pieces' totals."""
    firsts = samples.groupBy(by, t).agg(*(F.min_by(v, F.coalesce(F.col(tie), F.lit(0)) if tie else F.lit(0)).alias(v) for v in values))
    p = scan.pieces(cut(firsts.withColumn("_row", F.struct(t, *values)).select(by, t, "_row")), by, (t,), ranges)
    ends = scan.totals(p, by, _head=scan.first("_row"), _until=F.max(t))
    a = scan.along(by)
    ends = ends.select(by, scan.PIECE, F.lead("_head").over(a).alias("_over"), F.max("_until").over(a.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_until"))
    n = scan.carried(p.withColumn("_next", F.lead("_row").over(scan.inside(by))), ends, by, "_over", "_until")
    n = n.withColumn("_next", F.coalesce("_next", "_over")).where("_next is not null")
    nexts = [F.col("_next")[v].alias(f"{v}_1") for v in values]
    return n.select(by, F.col(t).alias("t0"), *(F.col("_row")[v].alias(f"{v}_0") for v in values), F.col("_next")[t].alias("t1"), *nexts, (F.col("_next")[t] == F.col("_until")).alias("last"))


def interpolated(frames: DataFrame, samples: DataFrame, values: tuple[str, ...], by: str = "drive_id", t: str = "t", tie: str | None = None, bucket_s: float = 60.0) -> DataFrame:
    """frames (by, t, …) with each value at the frame's time: linear between the neighbouring samples, and along the first or last segment beyond them.

    A range join by buckets of time: a segment lies in the buckets it spans, a frame in one; a frame outside its drive's samples looks into the
    first or last bucket. Frames of drives with fewer than two samples are left out. No drive is gathered in a task.
    """
    s = segments(samples, values, by, t, tie)
    ends = s.groupBy(by).agg(F.min("t0").alias("_from"), F.max("t1").alias("_to"))
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket_s), F.floor(F.col("t1") / bucket_s))))
    f = frames.join(ends, by).withColumn("_t", F.least(F.greatest(F.col(t), F.col("_from")), F.col("_to"))).withColumn("_bucket", F.floor(F.col("_t") / bucket_s))
    j = f.join(s, [by, "_bucket"]).where((F.col("t0") <= F.col("_t")) & ((F.col("_t") < F.col("t1")) | F.col("last") & (F.col("_t") == F.col("t1"))))
    at = lambda v: F.col(f"{v}_0") + (F.col(f"{v}_1") - F.col(f"{v}_0")) * ((F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return j.select(*frames.columns, *(at(v).alias(v) for v in values))


def frame_time(frame_id: Column, first: Column, spec: Frames = Frames()) -> Column:
    """The camera has no clock: frames follow the first sample at the frame rate."""
    return first + (frame_id - spec.start) / spec.fps


def manifest(frame_ids: DataFrame, samples: DataFrame, spec: Frames = Frames(), by: str = "drive_id", tie: str | None = None, bucket_s: float = 60.0) -> DataFrame:
    """(drive, frame_id, timestamp, latitude, longitude, heading_deg): the pose of each frame. samples: drive, t, lat, lon, yaw; tie orders those of one time."""
    starts = samples.groupBy(by).agg(F.min("t").alias("_first"))
    f = frame_ids.join(starts, by).withColumn("t", frame_time(F.col("frame_id"), F.col("_first"), spec)).drop("_first")
    p = interpolated(f, unwrapped(samples, "yaw", "heading", by, ("t", tie) if tie else ("t",)), ("lat", "lon", "heading"), by, tie=tie, bucket_s=bucket_s)
    return p.select(by, "frame_id", F.col("t").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), mod(F.col("heading"), 360).alias("heading_deg"))


def nested_manifest(rows: DataFrame, image_dir: str, lens: str = "LENS1", lidar: tuple[str, str] = ("", "")) -> DataFrame:
    """manifest rows as the records that later stages read from disk."""
    path = F.concat(F.lit(image_dir.rstrip("/") + "/"), F.format_string("frame_%06d.jpg", "frame_id"))
    return rows.select(
        "frame_id", "timestamp", F.struct(F.lit(lens).alias("lens"), path.alias("path")).alias("camera_data"),
        F.struct(F.lit(lidar[0]).alias("l1"), F.lit(lidar[1]).alias("l2")).alias("lidar_data"), F.struct("latitude", "longitude", "heading_deg").alias("ego_pose"),
    )
