"""Survey inputs: IMU and building files, images, records of earlier stages, frame lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Frames
from ..functions.polygon import longest_side_m

IMU_COLUMNS = {"t_unix": "t", "filter_lla_lat": "lat", "filter_lla_lon": "lon", "yaw_deg": "yaw"}

MATCH = """frame_id long, best_match struct<centroid_lat double, centroid_lon double, dist_m double, bearing_deg double, angle_off_deg double, score double,
score_angle double, score_prox double, score_width double, score_depth double, confidence double, footprint_w_m double, geometry string>,
all_candidates array<struct<centroid_lat double, centroid_lon double, dist_m double, angle_off_deg double, score double>>"""


def read_imu(spark: SparkSession, path: str, drive_id: int = 0) -> DataFrame:
    """(drive_id, t, lat, lon, yaw) of a CSV with # comments and padded header names; rows whose four columns aren't all numbers are dropped."""
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip(): c for c in raw.columns}
    cols = [F.col(f"`{named[c]}`").try_cast("double").alias(n) for c, n in IMU_COLUMNS.items()]
    return raw.select(F.lit(drive_id).cast("long").alias("drive_id"), *cols).dropna(subset=list(IMU_COLUMNS.values()))


def resolved(columns: list[str]) -> dict[str, str | None]:
    """Which column is what: the first whose lower-case name contains lat, lon, conf, or one of poly, geom, wkt, geometry, shape."""
    first = lambda *parts: next((c for c in columns if any(p in c.lower() for p in parts)), None)
    return {"lat": first("lat") or "centroid_lat", "lon": first("lon") or "centroid_lon", "confidence": first("conf"), "geometry": first("poly", "geom", "wkt", "geometry", "shape")}


def as_buildings(raw: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(building_id, b_lat, b_lon, confidence, geometry, footprint_w_m) of a table with a row number `row` (or none: then ids follow a hash of the place, which any order of rows gives alike).

    Rows without coordinates are dropped; a confidence that is no number is 0 when a minimum is asked for.
    """
    names = resolved(raw.columns)
    num = lambda k: F.col(f"`{names[k]}`").try_cast("double") if names[k] else F.lit(None).cast("double")
    geometry = F.coalesce(F.col(f"`{names['geometry']}`").cast("string"), F.lit("")) if names["geometry"] else F.lit("")
    id_ = F.col("row").cast("long") if "row" in raw.columns else F.xxhash64(*(F.col(f"`{c}`") for c in raw.columns))
    b = raw.select(id_.alias("building_id"), num("lat").alias("b_lat"), num("lon").alias("b_lon"), num("confidence").alias("confidence"), geometry.alias("geometry")).dropna(subset=["b_lat", "b_lon"])
    if names["confidence"] and min_confidence > 0:
        b = b.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).where(F.col("confidence") >= min_confidence)
    return b.withColumn("footprint_w_m", longest_side_m(F.col("geometry")))


def read_buildings(spark: SparkSession, path: str, min_confidence: float = 0.0) -> DataFrame:
    """Buildings of a CSV whose outlines may hold commas and line ends. Write the result to Parquet once; later reads then push filters down."""
    return as_buildings(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True), min_confidence)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, path, content) of files named frame_<number>.jpg."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").load(path)
    return raw.select(F.regexp_extract("path", r"frame_(\d+)\.jpg$", 1).try_cast("long").alias("frame_id"), "path", "content").where("frame_id IS NOT NULL")


def missing(frames: DataFrame, found: DataFrame) -> DataFrame:
    return frames.join(found.select("frame_id"), "frame_id", "left_anti")


def read_stage(spark: SparkSession, path: str, schema: str, suffix: str = "match") -> DataFrame:
    """Records of a stage, one JSON file per frame; the frame's number comes from the file's name, names without one are left out."""
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"frame_*_{suffix}.json").json(path)
    id_ = F.regexp_extract(F.col("_metadata.file_name"), r"frame_(\d+)_", 1).try_cast("long")
    return raw.withColumn("frame_id", F.coalesce("frame_id", id_)).where("frame_id IS NOT NULL")


def matches_between(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Best matches of a range of frames, flat."""
    r = rows.where(F.col("frame_id").between(start, end) & F.col("best_match").isNotNull())
    return r.select("frame_id", "best_match.*", F.size("all_candidates").alias("n_candidates")).withColumnsRenamed({"centroid_lat": "b_lat", "centroid_lon": "b_lon"})


def only_selected(rows: DataFrame, selected: DataFrame) -> DataFrame:
    return rows.join(selected.select("frame_id"), "frame_id", "left_semi")


def frame_ids(spark: SparkSession, spec: str | Frames = Frames()) -> DataFrame:
    """(frame_id): of "7,9,12", of "10-90" or "10-90:5", or of a range with a step."""
    if isinstance(spec, Frames):
        return spark.range(spec.start, spec.end + 1, spec.step).toDF("frame_id")
    if "," in spec or spec.strip().isdigit():
        return spark.createDataFrame([(int(x),) for x in spec.split(",") if x.strip()], "frame_id long")
    span, _, step = spec.partition(":")
    a, b = span.split("-")
    return spark.range(int(a), int(b) + 1, int(step or 1)).toDF("frame_id")
