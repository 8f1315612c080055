"""LiDAR points: fusion of two sensors, projection into the image, robust depth of what a mask or box covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SECOND_TO_FIRST, Camera
from ..functions.basic import with_once
from ..shared import cut
from .quantile import met_percentile, percentiles


def transformed(points: DataFrame, matrix: tuple[tuple[float, ...], ...] = SECOND_TO_FIRST) -> DataFrame:
    """points with x, y, z in another frame of reference, as single-precision numbers."""
    row = lambda r: (r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]).cast("float")
    return points.withColumns({c: row(r) for c, r in zip("xyz", matrix, strict=True)})


def fused(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """Both sensors' points in the first one's frame; a missing side gives the other."""
    if second is None:
        return first
    moved = transformed(second)
    return moved if first is None else first.unionByName(moved, allowMissingColumns=True)


def projected(points: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """points with u, v (pixels) and depth for those in view: in the frustum before the division, in the image after it."""
    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    p = with_once(points, {f"_{c}": row(r) for c, r in zip("xyz", camera.from_lidar, strict=True)})
    p = p.where("_z > 1.5 AND _z < 80 AND abs(_x) < 50 AND _y > -1.5 AND _y < 12")
    p = with_once(p, {"u": camera.fx * F.col("_x") / F.col("_z") + camera.cx, "v": camera.fy * F.col("_y") / F.col("_z") + camera.cy, "depth": F.col("_z")})
    return p.where((F.col("u") >= 0) & (F.col("u") < camera.width) & (F.col("v") >= 0) & (F.col("v") < camera.height)).drop("_x", "_y", "_z")


def in_time(points: DataFrame, frames: DataFrame, time_window_s: float, ts: str = "packet_ts", t: str = "t") -> DataFrame:
    """points with the frame_id of each frame (frame_id, t) in whose time window they were measured: at most half of it from the frame's time, both ends included. A point belongs to as many frames as have it in theirs, or to none.

    A range join by buckets as wide as the window: a frame looks into the two or three that its window touches. Other stages take the whole cloud for every frame; this is an option, for a vehicle that moves. Null times meet nothing.
    """
    half = time_window_s / 2
    bucket = lambda x: F.floor(x / time_window_s).cast("long")
    f = frames.select("frame_id", F.col(t).alias("_t")).where("_t IS NOT NULL").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_t") - half) - 1, bucket(F.col("_t") + half) + 1)))
    p = points.withColumn("_bucket", bucket(F.col(ts)))
    return p.join(f, "_bucket").where(F.abs(F.col(ts) - F.col("_t")) <= half).drop("_bucket", "_t")


def in_mask(seen: DataFrame, runs: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """(frame_id, depth) of the points whose pixel is in a frame's mask. runs: frame_id, row, u_start, u_end (exclusive), as operators.detect.mask_runs gives them, disjoint in a row.

    The cloud is projected once and joined to all frames on the pixel's row: an equi-join with a range check.
    """
    s = seen.select(F.floor("u").cast("int").alias("_u"), F.floor("v").cast("int").alias("row"), "depth")
    return s.join(runs, "row").where((F.col("_u") >= F.col("u_start")) & (F.col("_u") < F.col("u_end"))).select("frame_id", "depth")


def mask_depth(covered: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, depth, n): the 35th percentile of what lies between the 5th and 95th, and how many that is. Fewer than 5 points, or 3 after trimming, give no row. Groups may be of any size."""
    points = cut(covered.select(key, "depth").where("depth IS NOT NULL"))
    cuts = percentiles(points, "depth", {"_lo": 0.05, "_hi": 0.95}, by=(key,), written=True).where("n >= 5").drop("n")
    trimmed = points.join(cuts, key).where(F.col("depth").between(F.col("_lo"), F.col("_hi")))
    return percentiles(trimmed, "depth", {"depth": 0.35}, by=(key,)).where("n >= 3")


def _meeting(regions: DataFrame, cloud: DataFrame, px: int) -> DataFrame:
    """regions (_x1, _y1, _x2, _y2; ends included, and what else they have) with depth and n of the cloud's points within each, which meet by tiles of px pixels."""
    tile = lambda c: F.floor(F.col(c) / px).cast("long")
    c = cloud.select("u", "v", "depth", "n", tile("u").alias("_ku"), tile("v").alias("_kv"))
    ends = c.agg(*(f(k).alias(f"{n}{k}") for k in ("_ku", "_kv") for n, f in (("_from", F.min), ("_to", F.max))))
    r = regions.where("_x2 >= _x1 AND _y2 >= _y1").join(F.broadcast(ends))  # one row
    for k, one, two in (("_ku", "_x1", "_x2"), ("_kv", "_y1", "_y2")):
        first, last = F.greatest(tile(one), F.col(f"_from{k}")), F.least(tile(two), F.col(f"_to{k}"))
        r = r.withColumn(k, F.explode(F.when(first <= last, F.sequence(first, last))))
    r = r.drop(*(f"{n}{k}" for k in ("_ku", "_kv") for n in ("_from", "_to")))
    return c.join(r.hint("merge"), ["_ku", "_kv"]).where("u BETWEEN _x1 AND _x2 AND v BETWEEN _y1 AND _y2").drop("_ku", "_kv", "u", "v", "_x1", "_y1", "_x2", "_y2")


def _in_regions(regions: DataFrame, cloud: DataFrame, key: str, px: int) -> DataFrame:
    """(key, depth, n) of the points within each region."""
    return _meeting(regions, cloud, px).select(key, "depth", "n")


#: Depths that count where there is no mask.
NEAR_M, FAR_M = 2.0, 80.0


def box_depth(boxes: DataFrame, seen: DataFrame, key: str = "frame_id", bucket_px: int = 64) -> DataFrame:
    """(key, depth, n) when a mask is too sparse. boxes: key, x1, y1, x2, y2; seen: the projected cloud (u, v, depth), the same for all.

    The centre strip's 35th percentile if more than 3 points lie in it, else the box's, else the 40th of all (n is 0 then), else 25 m. Depths
    outside 2 to 80 m don't count. Regions meet points by tiles of pixels: strips first, and whole boxes only where the strip has too few points. Pairs of a region and a point are counted where
    they are made and neither written nor exchanged (met_percentile), so disk grows with the boxes and with the cloud, not with both. Points that are the same are one, with their number. No task holds a cloud, nor all of a box's points.
    """
    cloud = cut(seen.where((F.col("depth") > NEAR_M) & (F.col("depth") < FAR_M)).groupBy("u", "v", "depth").agg(F.count("*").alias("n")))
    named = lambda df: df.withColumnsRenamed({"depth": "value", "n": "times"})

    def within(regions: DataFrame, x: str, n: str) -> DataFrame:
        met = named(_in_regions(regions, cloud, key, bucket_px))
        return met_percentile(regions, met, lambda r: named(_meeting(r, cloud, bucket_px)), key, 0.35, NEAR_M, FAR_M).select(key, F.col("x").alias(x), F.col("n").alias(n))

    cx, cy, sw, sh = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, (F.col("x2") - F.col("x1")) * 0.10, (F.col("y2") - F.col("y1")) * 0.30
    middle = boxes.where("x2 >= x1 AND y2 >= y1").select(key, (cx - sw).alias("_x1"), (cy - sh).alias("_y1"), (cx + sw).alias("_x2"), (cy + sh).alias("_y2"))
    strips = within(middle, "_s", "_sn").where("_sn > 3")
    sparse = cut(boxes.join(strips.select(key), key, "left_anti").select(key, *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2"))))
    whole = within(sparse, "_b", "_bn")
    every, one = lambda r: named(cloud).join(F.broadcast(r)), seen.sparkSession.range(1)
    rest = met_percentile(one, every(one), every, "id", 0.4, NEAR_M, FAR_M).agg(F.max("x").alias("_a"))
    g = boxes.select(key).join(strips, key, "left").join(whole, key, "left").join(F.broadcast(rest))  # one row
    depth = F.when(F.col("_sn") > 3, F.col("_s")).when(F.col("_bn") > 3, F.col("_b")).otherwise(F.coalesce("_a", F.lit(25.0)))
    return g.select(key, depth.alias("depth"), F.when(F.col("_sn") > 3, F.col("_sn")).when(F.col("_bn") > 3, F.col("_bn")).otherwise(0).cast("long").alias("n"))


def depths(boxes: DataFrame, from_mask: DataFrame, seen: DataFrame, key: str = "frame_id") -> DataFrame:
    """boxes with median_depth and depth_pts: from the mask where it has enough points, else by the ladder of box_depth."""
    m = from_mask.withColumnsRenamed({"depth": "_d", "n": "_n"})
    rest = boxes.join(m.select(key), key, "left_anti")
    got = boxes.join(m.unionByName(box_depth(rest, seen, key).withColumnsRenamed({"depth": "_d", "n": "_n"})), key, "left")
    return got.withColumn("median_depth", F.coalesce("_d", F.lit(25.0))).withColumn("depth_pts", F.coalesce("_n", F.lit(0)).cast("long")).drop("_d", "_n")


def thinned(points: DataFrame, most: int, order: Column) -> DataFrame:
    """About `most` of the points for drawing: every k-th by a hash of their identity."""
    k = points.agg(F.greatest(F.lit(1), F.expr(f"count(*) div {most}")).alias("_k"))
    return points.join(F.broadcast(k)).where(F.pmod(F.xxhash64(order), F.col("_k")) == 0).drop("_k")  # one row
