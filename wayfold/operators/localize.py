"""Target points: where the ray of a frame's heading ends at the measured depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import destination, map_url


def targets(poses: DataFrame, depths: DataFrame, lat_offset: float = 0.0, lon_offset: float = 0.0) -> DataFrame:
    """Frames with a pose (frame_id, latitude, longitude, heading_deg) and a depth (frame_id, median_depth): raw and shifted target and a map address."""
    j = poses.join(depths.select("frame_id", F.col("median_depth").alias("depth_m")), "frame_id")
    j = j.withColumn("_p", destination(F.col("latitude"), F.col("longitude"), F.col("heading_deg"), F.col("depth_m")))
    j = j.select("frame_id", F.col("latitude").alias("ego_lat"), F.col("longitude").alias("ego_lon"), "heading_deg", "depth_m", F.col("_p.lat").alias("raw_target_lat"), F.col("_p.lon").alias("raw_target_lon"))
    j = j.withColumns({"target_lat": F.col("raw_target_lat") + lat_offset, "target_lon": F.col("raw_target_lon") + lon_offset})
    return j.withColumn("gmaps", map_url(F.col("target_lat"), F.col("target_lon")))


def seen_from(targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """What matching starts from: targets' rows (ego_lat, ego_lon, heading_deg, depth_m) of frames that have a box (frame_id, x1, x2, img_w), as lat, lon, heading, depth and frac, the share of the image's width that the box takes (0 for an image without width)."""
    b = boxes.select("frame_id", F.coalesce(F.when(F.col("img_w") > 0, (F.col("x2") - F.col("x1")) / F.col("img_w")), F.lit(0.0)).alias("frac"))
    t = targets.select("frame_id", F.col("ego_lat").alias("lat"), F.col("ego_lon").alias("lon"), F.col("heading_deg").alias("heading"), F.col("depth_m").alias("depth"))
    return t.join(b, "frame_id")


def raw_targets(rows: DataFrame, lat_offset: float = 0.0, lon_offset: float = 0.0, zero_is_missing: bool = True) -> DataFrame:
    """rows with raw_lat, raw_lon: the raw target where it is there (and not 0, unless told otherwise), else the target without the offset."""
    pick = lambda raw, t, o: F.coalesce(F.nullif(F.col(raw), F.lit(0.0)) if zero_is_missing else F.col(raw), F.col(t) - o)
    return rows.withColumns({"raw_lat": pick("raw_target_lat", "target_lat", lat_offset), "raw_lon": pick("raw_target_lon", "target_lon", lon_offset)})
