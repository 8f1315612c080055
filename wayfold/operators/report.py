"""Reports: unique buildings, sightings, error statistics, track summaries, dashboard tables, checks of each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import METRES_PER_DEGREE
from ..functions.geo import cell_key, haversine_m, map_url
from ..shared import cut
from ..sources.sinks import nested
from .quantile import percentiles


def unique_best(matches: DataFrame) -> DataFrame:
    """The best sighting of each building (first frame on ties), numbered gob_0, gob_1, … by first appearance."""
    kept = [c for c in matches.columns]
    g = matches.groupBy(cell_key(F.col("b_lat"), F.col("b_lon")).alias("_k")).agg(F.min("frame_id").alias("first_frame"), F.max_by(F.struct(*kept), F.struct(F.col("score"), -F.col("frame_id"))).alias("_b"))
    return numbered(g.select("first_frame", "_b.*"), "first_frame", "n").withColumn("id", F.concat(F.lit("gob_"), F.col("n").cast("string"))).drop("n")


def numbered(df: DataFrame, order: str, out: str, ranges: int | None = None) -> DataFrame:
    """df with its rows numbered from 0 in an order that has no ties. Rows are dealt into ranges of the order that hold about as many each, whatever its values; ranges are counted, and each task numbers one, not all rows. df is computed once, to the shared folder."""
    d = cut((df.repartitionByRange(ranges, order) if ranges else df.repartitionByRange(order)).withColumn("_bucket", F.spark_partition_id()))
    counts = d.groupBy("_bucket").agg(F.count("*").alias("_c"))
    before = counts.select("_bucket", (F.sum("_c").over(W.orderBy("_bucket")) - F.col("_c")).alias("_before"))  # as many rows as ranges
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(order)) - 1
    return d.join(F.broadcast(before), "_bucket").withColumn(out, (F.col("_before") + rank).cast("long")).drop("_bucket", "_before")


def running_unique(matches: DataFrame) -> DataFrame:
    """(frame_id, unique_count): how many buildings the frames up to this one have shown. matches: one row per frame."""
    w = W.partitionBy(cell_key(F.col("b_lat"), F.col("b_lon"))).orderBy("frame_id")
    m = matches.select("frame_id", (F.row_number().over(w) == 1).cast("int").alias("_new"))
    n = numbered(m, "frame_id", "_n")
    b = n.withColumn("_bucket", F.expr("_n div 10000"))
    totals = b.groupBy("_bucket").agg(F.sum("_new").alias("_s"))
    before = totals.select("_bucket", (F.sum("_s").over(W.orderBy("_bucket")) - F.col("_s")).alias("_before"))
    inside = F.sum("_new").over(W.partitionBy("_bucket").orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("_inside", inside).join(before, "_bucket").select("frame_id", (F.col("_before") + F.col("_inside")).alias("unique_count"))


def sightings(matches: DataFrame, depth: str | None = None) -> DataFrame:
    """A row per building: mean place, frames, frame_ids in order, mean and best score, the best frame, mean depth (null where nothing was measured)."""
    d = F.avg(F.nullif(F.col(depth), F.lit(0.0))) if depth else F.lit(None).cast("double")
    g = matches.groupBy(cell_key(F.col("b_lat"), F.col("b_lon")).alias("_k")).agg(
        F.min("frame_id").alias("first_frame"), F.avg("b_lat").alias("mean_lat"), F.avg("b_lon").alias("mean_lon"), F.count("*").alias("frames"), F.sort_array(F.collect_list("frame_id")).alias("frame_ids"),
        F.avg("score").alias("mean_raw_score"), F.max("score").alias("best_score"), F.max_by("frame_id", F.struct(F.col("score"), -F.col("frame_id"))).alias("best_frame_id"), d.alias("mean_depth_m"),
    )
    return numbered(g.drop("_k"), "first_frame", "track_id").withColumn("track_id", F.col("track_id").cast("string"))


def gps_comparison(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """A record for each matched frame that has a target (ego_lat, ego_lon, heading_deg, target_lat, target_lon, depth_m): where the vehicle was, what was estimated, the building that matched, and the metres between the last two. error_stats of them is the summary."""
    given = lambda c: c if c in matches.columns else F.lit(None).cast("double").alias(c)
    t = targets.select("frame_id", "ego_lat", "ego_lon", "heading_deg", "target_lat", "target_lon", "depth_m")
    j = matches.select("frame_id", "b_lat", "b_lon", "score", "angle_off_deg", "dist_m", *map(given, ("confidence", "footprint_w_m", "score_angle", "score_prox", "score_width", "score_depth"))).join(t, "frame_id")
    c = F.col
    return j.select(
        "frame_id",
        F.struct(c("ego_lat").alias("lat"), c("ego_lon").alias("lon"), "heading_deg").alias("vehicle_gps"),
        F.struct(c("target_lat").alias("lat"), c("target_lon").alias("lon"), "depth_m", map_url(c("target_lat"), c("target_lon")).alias("gmaps")).alias("estimated_gps"),
        F.struct(c("b_lat").alias("lat"), c("b_lon").alias("lon"), "score", "angle_off_deg", "dist_m", "confidence", "footprint_w_m", "score_angle", "score_prox", "score_width", "score_depth", map_url(c("b_lat"), c("b_lon")).alias("gmaps")).alias("gob_match_gps"),
        F.round(haversine_m(c("target_lat"), c("target_lon"), c("b_lat"), c("b_lon")), 3).alias("error_est_to_gob_m"),
    )


def error_stats(errors: DataFrame, err: str = "err", frame: str = "frame_id") -> DataFrame:
    """One row over errors in metres (rounded to 3 places first): mean, median, extremes, deviation, best and worst frame, and shares under 15, 30 and 50 m."""
    e = cut(errors.select(frame, F.round(err, 3).alias("e")))
    under = lambda m: F.round(100 * F.avg((F.col("e") < m).cast("int")), 1).alias(f"pct_under_{m}m")
    r3 = lambda c, n: F.round(c, 3).alias(n)
    median = percentiles(e, "e", {"median_error_m": 0.5}, written=True).select(r3("median_error_m", "median_error_m"))
    rest = e.agg(
        F.count("*").alias("frames_processed"), r3(F.avg("e"), "avg_error_m"), r3(F.min("e"), "min_error_m"), r3(F.max("e"), "max_error_m"),
        r3(F.coalesce(F.stddev_samp("e"), F.lit(0.0)), "stdev_error_m"), F.min(F.struct("e", frame))[frame].alias("best_frame_id"), F.max(F.struct(F.col("e"), -F.col(frame))).getField("col2").alias("_w"), *(under(m) for m in (15, 30, 50)),
    )
    return rest.withColumn("worst_frame_id", -F.col("_w")).drop("_w").join(F.broadcast(median))  # one row each


def track_summary(rows: DataFrame, total: bool = True) -> DataFrame:
    """Per track: frames, mean place, spread in metres, smoothing and scores; total: and a row for all tracks (track_id null), by the same rollup."""
    g = (rows.rollup("track_id") if total else rows.groupBy("track_id")).agg(
        F.count("*").alias("frames"), F.avg("stable_lat").alias("mean_lat"), F.avg("stable_lon").alias("mean_lon"), (F.stddev_pop("stable_lat") * METRES_PER_DEGREE).alias("lat_spread_m"),
        (F.stddev_pop("stable_lon") * METRES_PER_DEGREE * F.cos(F.radians(F.avg("stable_lat")))).alias("lon_spread_m"), F.avg("smoothing_delta_m").alias("mean_smoothing_delta_m"),
        F.max("smoothing_delta_m").alias("max_smoothing_delta_m"), F.avg("raw_score").alias("mean_raw_score"), F.min("raw_score").alias("min_raw_score"), F.max("raw_score").alias("max_raw_score"),
    )
    return g


def track_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The record of tracks for tables of any size: its head, one row over stabilised frames with frames_processed, tracks_confirmed and the means and extremes of all; and its lines, each track's summary with a map address."""
    t = cut(track_summary(rows))
    each = t.where("track_id IS NOT NULL")
    head = t.where("track_id IS NULL").select(F.col("frames").alias("frames_processed"), "mean_smoothing_delta_m", "max_smoothing_delta_m", "mean_raw_score", "min_raw_score", "max_raw_score")
    head = head.join(F.broadcast(each.agg(F.count("*").alias("tracks_confirmed"))))  # one row each
    per_track = each.select("track_id", "frames", "mean_lat", "mean_lon", "lat_spread_m", "lon_spread_m", "mean_smoothing_delta_m", "max_smoothing_delta_m", "mean_raw_score", "min_raw_score", map_url(F.col("mean_lat"), F.col("mean_lon")).alias("gmaps"))
    return head, per_track


def track_record(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """track_parts as one row: the head, and per_track, the lines by track, as tools read them from one document."""
    head, per_track = track_parts(rows)
    return nested(head, most, per_track=per_track)


def kpis(dashboard: DataFrame) -> DataFrame:
    """One row: buildings, mean quality and match score, mean raw and calibrated error of those that have one."""
    return dashboard.agg(F.count("*").alias("buildings"), F.avg("quality_score").alias("mean_quality"), F.avg("score").alias("mean_match"), F.avg("error_m").alias("mean_raw_error_m"), F.avg("calibrated_error_m").alias("mean_calibrated_error_m"))


def dashboard(selected: DataFrame, calibrated: DataFrame, frames: tuple[int, ...] | None = None) -> DataFrame:
    """selected with each frame's calibrated error where there is one; frames: these alone."""
    s = selected.where(F.col("frame_id").isin(list(frames))) if frames else selected
    return s.join(calibrated.select("frame_id", "calibrated_error_m", "is_inlier"), "frame_id", "left")


def map_layers(dash: DataFrame) -> DataFrame:
    """(frame_id, layer, lat, lon, radius_m): where the vehicle was, and the building with a ring of its error."""
    ring = F.coalesce("calibrated_error_m", "error_m")
    layers = F.array(F.struct(F.lit("ego").alias("layer"), F.col("ego_lat").alias("lat"), F.col("ego_lon").alias("lon"), F.lit(None).cast("double").alias("radius_m")), F.struct(F.lit("building").alias("layer"), F.col("smooth_lat").alias("lat"), F.col("smooth_lon").alias("lon"), ring.alias("radius_m")))
    return dash.select("frame_id", F.inline(layers)).where("lat IS NOT NULL")


def diagnostics(rows: DataFrame, lat: tuple[float, float] = (12.5, 13.5), lon: tuple[float, float] = (79.5, 80.5)) -> DataFrame:
    """Each frame's checks as columns: pose in the expected box, depth 2 to 60 m, detection confidence .10 or more, target within 200 m; and a verdict, the first that fails."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "pose_ok": ok(F.col("ego_lat").between(*lat) & F.col("ego_lon").between(*lon)),
        "depth_ok": ok(F.col("depth_m").between(2, 60)),
        "detection_ok": ok(F.col("det_conf") >= 0.10),
        "target_ok": ok(haversine_m(F.col("ego_lat"), F.col("ego_lon"), F.col("target_lat"), F.col("target_lon")) <= 200),
    }
    verdict: Column = F.lit("ok")
    for name in reversed(checks):
        verdict = F.when(~F.col(name), name.removesuffix("_ok")).otherwise(verdict)
    return rows.select("frame_id", *(c.alias(n) for n, c in checks.items())).withColumn("verdict", verdict)
