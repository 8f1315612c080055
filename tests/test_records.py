import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import polygon
from wayfold.operators import calibrate, detect, report
from wayfold.sources import sinks


def rings(spark, *texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "building_id long, geometry string, note string")
    out = {k: {} for k in range(len(texts))}
    for r in polygon.with_rings(df).collect():
        out[r.building_id].setdefault((r.polygon, r.hole), []).append((r.vertex, r.lon, r.lat))
    return [{k: [v[1:] for v in sorted(vs)] for k, vs in x.items()} for x in out.values()]


def test_rings(spark):
    got = rings(
        spark, "POLYGON((1 2, 3 4,5 6))", None, "", "no outline 1 2", "polygon Z ((1 2 9, 1e1 -.5 9, x y, 3), (7 8, 9 10))", "MULTIPOLYGON(((1 2, 3 4)),((5 6, 7 8),(9 10, 11 12)))",
        "GEOMETRYCOLLECTION(POINT(4 6), POLYGON((1 2,3 4)), LINESTRING(4 6,7 10), POLYGON((5 6)))", "POLYGON EMPTY", "SRID=4326;POLYGON((1 2))", "POLYGON((1 2, 3 4",
    )
    assert got == [
        {(0, 0): [(1, 2), (3, 4), (5, 6)]}, {}, {}, {}, {(0, 0): [(1, 2), (10, -0.5)], (0, 1): [(7, 8), (9, 10)]}, {(0, 0): [(1, 2), (3, 4)], (1, 0): [(5, 6), (7, 8)], (1, 1): [(9, 10), (11, 12)]},
        {(0, 0): [(1, 2), (3, 4)], (1, 0): [(5, 6)]}, {}, {(0, 0): [(1, 2)]}, {(0, 0): [(1, 2), (3, 4)]},
    ]


def test_a_model_is_loaded_once_for_each_worker(spark, tmp_path):
    path = str(tmp_path)

    def load():
        with open(f"{path}/{os.getpid()}-{random.random()}", "w"):
            pass
        return lambda content, classes, conf, crop: [(1000.0, 100.0, 2000.0, 2000.0, 0.5)]

    images = spark.range(40).select(F.col("id").alias("frame_id"), F.lit(b"x").alias("content")).repartition(20)
    for _ in range(2):
        assert detect.detections(images, load, key="stub").count() == 40
    pids = [x.split("-")[0] for x in os.listdir(path)]
    assert len(pids) == len(set(pids)) < 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 64 << 20


def test_records_of_calibration(spark):
    rng = random.Random(3)
    square = "POLYGON((80.2 12.9, 80.2001 12.9, 80.2001 12.9001, 80.2 12.9001))"
    rows = [(k, 12.90005, 80.20005 + k % 3, 50.0 + k, 12.9 + rng.uniform(0, 3e-4), 80.2 + k % 3 + rng.uniform(0, 3e-4), square if k % 3 == 0 else "") for k in range(30)]
    r = spark.createDataFrame(rows, "frame_id long, b_lat double, b_lon double, score double, raw_lat double, raw_lon double, geometry string")
    on = calibrate.per_building(r)
    got = calibrate.offset_record(r, on, 40.0).first()
    o = calibrate.mean_offsets(on).first()
    assert got.calibration.n_frames_used == 3 and got.calibration.avg_dlat == o.avg_dlat and got.calibration.cfg_lines[1] == f"PROJECTION_LON_OFFSET = {o.avg_dlon:.6f}"
    assert [x.frame_id for x in got.buildings] == list(range(30)) and got.summary.total_frames == 30 and got.summary.unique_buildings == got.calibration.n_buildings_covered == 3
    assert {x.frame_id: x.corrected_error_m for x in got.buildings} == {x.frame_id: x.corrected_error_m for x in calibrate.evaluated(r, calibrate.mean_offsets(on)).collect()}
    with pytest.raises(ValueError, match="lines"):
        calibrate.offset_record(r, on, most=29)
    g = r.withColumns({"lat": F.col("raw_lat"), "lon": F.col("raw_lon"), "heading": F.lit(90.0), "depth": F.lit(5.0)})
    best = calibrate.running_best(calibrate.grid_scores(calibrate.grid_errors(g)))
    n = calibrate.grid_record(best, g).first()
    b = best.first()
    assert (n.along_offset_m, n.total_frames, n.sub3m_hits, n.target_achieved) == (round(b.along, 2), 30, b.inside, b.met)
    assert n.inlier_count == sum(f.is_inlier for f in n.frames) and len(n.frames) == 30
    assert sinks.nested(spark.range(1).toDF("k"), none=r.limit(0)).first().none == []


def test_record_of_tracks(spark):
    rows = spark.createDataFrame([(str(k % 4), 12.9 + k * 1e-6, 80.2, float(k), 50.0 + k) for k in range(20)], "track_id string, stable_lat double, stable_lon double, smoothing_delta_m double, raw_score double")
    got = report.track_record(rows).first()
    assert (got.frames_processed, got.tracks_confirmed, got.max_raw_score, got.max_smoothing_delta_m) == (20, 4, 69.0, 19.0)
    assert [t.track_id for t in got.per_track] == ["0", "1", "2", "3"] and got.per_track[1].frames == 5 and got.per_track[0].gmaps.endswith("12.90000800,80.20000000")
