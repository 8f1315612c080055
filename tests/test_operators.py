import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.config import CURATED_FRAMES
from wayfold.functions import geo
from wayfold.operators import calibrate, detect, lidar, localize, match, report, select, timeline, track
from wayfold.operators.track import metres
from wayfold.sources import pcap, sinks, tables
from wayfold.streaming import events, tracker

SF = "/root/testdata/sf0.001"


def test_radius_join_far_from_the_equator(spark):
    rng = random.Random(1)
    f = [(i, 62.0 + rng.uniform(-0.01, 0.01), -0.005 + rng.uniform(-0.02, 0.02)) for i in range(150)] + [(999, None, 1.0)]
    b = [(i, 62.0 + rng.uniform(-0.01, 0.01), rng.uniform(-0.02, 0.02)) for i in range(150)] + [(998, 62.0, None)]
    got = match.radius_join(spark.createDataFrame(f, "frame_id long, lat double, lon double"), spark.createDataFrame(b, "building_id long, b_lat double, b_lon double")).collect()
    near = lambda x, y: None not in (*x, *y) and metres(x[1], x[2], y[1], y[2]) <= 150 and abs(y[1] - x[1]) <= 150 / 111320 and abs(y[2] - x[2]) <= 150 / (111320 * math.cos(math.radians(x[1])))
    assert sorted((r.frame_id, r.building_id) for r in got) == sorted((x[0], y[0]) for x in f for y in b if near(x, y))


def test_unwrap_and_interpolation(spark):
    rng = random.Random(2)
    yaw = [rng.choice([0.0, 90.0, 180.0, 270.0, rng.uniform(-720, 720)]) for _ in range(200)]
    s = spark.createDataFrame([(1, float(i), y, 0.5 * i, -i * 1.0) for i, y in enumerate(yaw)], "drive_id long, t double, yaw double, lat double, lon double")
    got = [r.h for r in timeline.unwrapped(s, "yaw", "h").orderBy("t").collect()]
    assert np.allclose(got, np.unwrap(yaw, period=360))
    f = spark.createDataFrame([(1, float(x)) for x in (-5.0, 0.0, 3.25, 198.9, 199.0, 230.0)] + [(2, 1.0)], "drive_id long, t double")
    p = timeline.interpolated(f, s, ("lat", "lon"), bucket_s=7.0).orderBy("t").collect()
    assert [(r.lat, r.lon) for r in p] == [pytest.approx((0.5 * r.t, -r.t)) for r in p] and len(p) == 6
    m = timeline.manifest(spark.createDataFrame([(1, 1), (1, 31)], "drive_id long, frame_id long"), s).orderBy("frame_id").collect()
    assert [r.timestamp for r in m] == [0.0, 1.0] and 0 <= m[1].heading_deg < 360


def test_leader_clusters_against_one_pass(spark):
    rng = random.Random(3)
    rows = [(i, 12.94 + rng.choice([0, 0.01]) + rng.uniform(0, 0.001), 80.23 + rng.uniform(0, 0.002)) for i in range(300)]
    rows += [(300 + i, *rows[i * 3][1:]) for i in range(50)]
    heads, expected = [], {}
    for i, lat, lon in rows:
        lead = next((h for h in heads if metres(lat, lon, h[1], h[2]) <= 18), None)
        if lead is None:
            heads.append(lead := (i, lat, lon))
        expected[i] = lead[0]
    got = select.leader_clusters(spark.createDataFrame(rows, "frame_id long, b_lat double, b_lon double").repartition(4))
    assert {r.frame_id: r.cluster for r in got.collect()} == expected


def packet(blocks, mark=0xEEFF):
    out = b""
    for azimuth, units in blocks:
        out += struct.pack("<HH", mark, azimuth) + b"".join(struct.pack("<HB", u, 7) for u in units)
    return out + bytes(1206 - len(out))


def test_pcap(spark, tmp_path):
    units = [0, 500, 501, 5000] + [1000] * 28
    frames = [bytes(42) + packet([(9000, units)] * 12), bytes(42) + packet([(100, units)] * 12, mark=1), b"short", bytes(42) + packet([(35999, units)] * 12)]
    for order in "<>":
        data = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for k, x in enumerate(frames):
            data += struct.pack(order + "IIII", 100 + k, 250_000, len(x), len(x)) + x
        (tmp_path / f"{'le' if order == '<' else 'be'}.pcap").write_bytes(data + b"cut")
    got = pcap.read_points(spark, str(tmp_path), "L1").collect()
    assert len(got) == 2 * 2 * 12 * 30 and {r.sensor for r in got} == {"L1"}
    one = next(r for r in got if r.laser_id == 3 and abs(r.azimuth - 90) < 1e-3 and abs(math.dist((r.x, r.y, r.z), (0, 0, 0)) - 10) < 1e-3)
    assert abs(one.packet_ts - 100.25) < 1e-6 and abs(one.z - 10 * math.sin(math.radians(3))) < 1e-4 and abs(one.x - 10 * math.cos(math.radians(3))) < 1e-4


def test_depths(spark):
    rng = np.random.default_rng(4)
    d = {1: rng.uniform(3, 70, 200).round(1), 2: rng.uniform(3, 70, 4), 3: np.array([5.0] * 6)}
    got = {r.frame_id: (r.depth, r.n) for r in lidar.mask_depth(spark.createDataFrame([(k, float(x)) for k, v in d.items() for x in v], "frame_id long, depth double")).collect()}
    t = d[1][(d[1] >= np.percentile(d[1], 5)) & (d[1] <= np.percentile(d[1], 95))]
    assert set(got) == {1, 3} and got[1] == (pytest.approx(np.percentile(t, 35)), len(t)) and got[3] == (5.0, 6)
    seen = spark.createDataFrame([(100.0 + i, 100.0, 10.0 + i) for i in range(20)], "u double, v double, depth double")
    boxes = spark.createDataFrame([(1, 100.0, 0.0, 119.0, 200.0), (2, 100.0, 90.0, 104.0, 101.0), (3, 900.0, 0.0, 910.0, 10.0)], "frame_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.frame_id: (r.depth, r.n) for r in lidar.box_depth(boxes, seen).collect()}
    assert got[1] == (pytest.approx(np.percentile([18, 19, 20, 21], 35)), 4) and got[2] == (pytest.approx(np.percentile(range(10, 15), 35)), 5) and got[3] == (pytest.approx(np.percentile(range(10, 30), 40)), 0)


def test_masks_and_detections(spark):
    m = np.zeros((60, 80))
    m[20:40, 10:50] = 1
    m[30, 30] = 0  # a hole that closing fills
    m[50, 70] = 1  # a speck that opening removes
    clean = detect.cleaned(m, 25)
    runs = detect.mask_runs(clean)
    assert not clean[:25].any() and clean[30, 30] and not clean[50, 70] and sum(b - a for _, a, b in runs) == clean.sum()

    def load():
        return lambda content, classes, conf, crop: [] if crop is None else [(10.0, 100.0, 900.0, 2000.0, 0.5), (0.0, 0.0, 1.0, 1.0, 0.9)]

    images = spark.createDataFrame([(7, b"x")], "frame_id long, content binary")
    got = detect.best_boxes(detect.detections(images, load)).collect()
    assert len(got) == 1 and got[0]["pass"] == 3 and got[0].x1 == 10 + int(3840 * 0.4)
    filled = detect.masks(images.selectExpr("*", "1D AS x1", "2D AS y1", "4D AS x2", "5D AS y2"), lambda: lambda content, box: None)
    assert sorted((r.row, r.u_start, r.u_end) for r in filled.collect()) == [(2, 1, 4), (3, 1, 4), (4, 1, 4)]
    inside = lidar.in_mask(spark.createDataFrame([(1.5, 2.5, 9.0), (4.0, 2.5, 8.0)], "u double, v double, depth double"), filled)
    assert [tuple(r) for r in inside.collect()] == [(7, 9.0)]


def test_files(spark, tmp_path):
    (tmp_path / "imu.csv").write_text("# by logger\nt_unix, filter_lla_lat, filter_lla_lon, yaw_deg, other\n1000.0, 12.9, 80.2, 350.0, x\n1000.1, bad, 80.2, 5.0, y\n")
    assert [tuple(r) for r in tables.read_imu(spark, str(tmp_path / "imu.csv")).collect()] == [(0, 1000.0, 12.9, 80.2, 350.0)]
    (tmp_path / "b.csv").write_text('Latitude,Longitude,confidence,geometry\n12.9,80.2,0.8,"POLYGON((80.2 12.9, 80.2001 12.9, 80.2001 12.9001, 80.2 12.9))"\n,80.2,0.9,\n12.8,80.1,x,\n')
    b = sorted(tables.read_buildings(spark, str(tmp_path / "b.csv")).collect(), key=lambda r: r.b_lat)
    assert [r.confidence for r in b] == [None, 0.8] and b[0].footprint_w_m is None and 10 < b[1].footprint_w_m < 20
    assert tables.read_buildings(spark, str(tmp_path / "b.csv"), 0.5).count() == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m/frame_000012_match.json").write_text('{"frame_id": 12, "best_match": {"centroid_lat": 1.0, "centroid_lon": 2.0, "score": 50.0}, "all_candidates": [{"score": 50.0}]}')
    (tmp_path / "m/frame_000013_match.json").write_text('{"best_match": null, "all_candidates": []}')
    (tmp_path / "m/frame_x_match.json").write_text("{}")
    rows = tables.read_stage(spark, str(tmp_path / "m"), tables.MATCH)
    assert sorted(r.frame_id for r in rows.collect()) == [12, 13]
    assert [(r.frame_id, r.b_lat, r.n_candidates) for r in tables.matches_between(rows, 1, 20).collect()] == [(12, 1.0, 1)]
    assert [r.frame_id for r in tables.frame_ids(spark, "3-9:3").collect()] == [3, 6, 9] and tables.frame_ids(spark, "4,8").count() == 2 and tables.frame_ids(spark).count() == 144
    sinks.write_stage(spark.range(25_000).toDF("frame_id"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).select("frame_bucket").distinct().count() == 3


def test_report_and_numbers(spark):
    rows = [(i, 12.9 + (i * 7 % 5) / 1e4, 80.2, float(i % 4), 10.0 + i) for i in range(50)]
    m = spark.createDataFrame(rows, "frame_id long, b_lat double, b_lon double, score double, err double")
    u = sorted(report.unique_best(m).collect(), key=lambda r: r.first_frame)
    assert [r.id for r in u] == [f"gob_{i}" for i in range(5)] and all(r.score == 3.0 for r in u)
    assert [r.unique_count for r in report.running_unique(m).orderBy("frame_id").collect()] == [1, 2, 3, 4] + [5] * 46
    s = report.error_stats(m).first()
    assert (s.best_frame_id, s.worst_frame_id, s.median_error_m, s.pct_under_30m) == (0, 49, 34.5, 40.0)
    got = report.numbered(spark.range(0, 5000, 7).toDF("k").unionByName(spark.createDataFrame([(10**15,)], "k long")), "k", "n", ranges=13).orderBy("k").collect()
    assert [r.n for r in got] == list(range(len(got)))
    assert report.unique_best(m.limit(0)).count() == 0


def test_targets(spark):
    poses = spark.createDataFrame([(1, 12.9, 80.2, 90.0)], "frame_id long, latitude double, longitude double, heading_deg double")
    t = localize.targets(poses, spark.createDataFrame([(1, 30.0)], "frame_id long, median_depth double"), 0.001, 0.0).first()
    assert abs(metres(12.9, 80.2, t.raw_target_lat, t.raw_target_lon) - 30) < 0.2 and abs(t.target_lat - t.raw_target_lat - 0.001) < 1e-12 and t.gmaps.endswith(f"{t.target_lat:.8f},{t.target_lon:.8f}")


def frames_of(spark):
    rng = random.Random(5)
    seen = []
    for drive in (1, 2):
        for k in range(60):
            best = None if rng.random() < 0.2 else [(1, 12.94 + drive + rng.uniform(0, 2e-5), 80.0, 20.0, rng.uniform(40, 80)), (2, 12.9402 + drive, 80.0, 20.0, rng.uniform(30, 60))]
            seen.append((drive, 100 * drive + k, best))
    return spark.createDataFrame(seen, "drive_id long, frame_id long, seen array<struct<rank:int,lat:double,lon:double,depth:double,score:double>>")


def test_event_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    for name, f in (("tumbling", events.tumbling_counts), ("sliding", events.sliding_means), ("sessions", events.sessions), ("dedup", lambda x: events.deduplicated(x, ["event_id"]))):
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "dedup" else "append").start()
        q.processAllAvailable()
        q.stop()
        whole_row = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        got, whole = {whole_row(r) for r in spark.table(name).collect()}, {whole_row(r) for r in f(e).collect()}
        assert got <= whole and len(got) >= 0.9 * len(whole)


def test_map_address(spark):
    assert spark.range(1).select(geo.map_url(F.lit(12.5), F.lit(80.25)).alias("u")).first().u.endswith("12.50000000,80.25000000")


def one_pass(rows):
    heads, expected = [], {}
    for i, lat, lon in rows:
        lead = next((h for h in heads if metres(lat, lon, h[1], h[2]) <= 18), None)
        if lead is None:
            heads.append(lead := (i, lat, lon))
        expected[i] = lead[0]
    return expected


@pytest.mark.parametrize(("tile", "halo"), [(64, 8), (2, 3), (3, 2.5)])
def test_leader_clusters_over_tiles(spark, monkeypatch, tile, halo):
    """A gapless city, gone through by a drive that crosses tiles back and forth and by places in no order."""
    monkeypatch.setattr(select, "TILE", tile)
    monkeypatch.setattr(select, "HALO", halo)
    rng = random.Random(7)
    rows = [(i, 12.94 + abs(i % 40 - 20) * 9e-5, 80.23 + i * 3e-5 % 6e-4) for i in range(150)] + [(150 + i, -12.94 + rng.uniform(0, 1.2e-3), 80.23 + rng.uniform(0, 1.2e-3)) for i in range(250)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(900, None, 1.0, 1)], "frame_id long, b_lat double, b_lon double, status int").repartition(4)
    got = {r.frame_id: r.cluster for r in select.leader_clusters(df.drop("status")).collect()}
    assert got.pop(900) is None and got == one_pass(rows)
    two = df.drop("status").withColumn("drive", F.when(F.col("frame_id") % 2 == 0, F.lit("a")))
    got = {r.frame_id: r.cluster for r in select.leader_clusters(two, within="drive").where("b_lat is not null").collect()}
    assert got == one_pass([r for r in rows if r[0] % 2 == 0]) | one_pass([r for r in rows if r[0] % 2])


def test_leader_clusters_on_the_table(spark):
    from wayfold.plans import views as V

    m = match.best_matches(V.frames(spark, SF), V.buildings(spark, SF)).select("frame_id", "b_lat", "b_lon")
    rows = sorted(map(tuple, m.collect()))
    assert {r.frame_id: r.cluster for r in select.leader_clusters(m).collect()} == one_pass(rows)


def test_joins_between_stages(spark):
    t = spark.createDataFrame([(1, 12.9, 80.2, 90.0, 20.0, 12.91, 80.21, 12.9101, 80.2101), (2, 12.9, 80.2, 0.0, 9.0, 12.92, 80.2, 0.0, None), (3, 12.9, 80.2, 0.0, 9.0, 1.0, 1.0, 1.0, 1.0)], "frame_id long, ego_lat double, ego_lon double, heading_deg double, depth_m double, target_lat double, target_lon double, raw_target_lat double, raw_target_lon double")
    boxes = spark.createDataFrame([(1, 100.0, 1060.0, 3840), (2, 0.0, 9.0, 0), (9, 1.0, 2.0, 3840)], "frame_id long, x1 double, x2 double, img_w int")
    assert sorted(tuple(r) for r in localize.seen_from(t, boxes).collect()) == [(1, 12.9, 80.2, 90.0, 20.0, 0.25), (2, 12.9, 80.2, 0.0, 9.0, 0.0)]
    m = spark.createDataFrame([(1, 12.911, 80.211, 80.0, 3.0, 9.0), (2, 12.92, 80.2, 40.0, 3.0, 9.0), (4, 1.0, 1.0, 90.0, 3.0, 9.0)], "frame_id long, b_lat double, b_lon double, score double, angle_off_deg double, dist_m double")
    got = {r.frame_id: r for r in calibrate.records(m, t, 40.0, 0.001, 0.002).collect()}
    assert set(got) == {1, 2} and got[1].raw_lat == 12.9101 and got[2].raw_lat == pytest.approx(12.919) and got[2].raw_lon == pytest.approx(80.198) and got[1].dlat == pytest.approx(0.0009)
    assert set(r.frame_id for r in calibrate.records(m, t, 41.0).collect()) == {1}
    whole = localize.raw_targets(t, zero_is_missing=False).orderBy("frame_id").collect()
    assert whole[1].raw_lat == 0.0 and whole[1].raw_lon == 80.2
    c = {r.frame_id: r for r in report.gps_comparison(m, t).collect()}
    assert set(c) == {1, 2} and c[2].error_est_to_gob_m == 0.0 and c[1].vehicle_gps.heading_deg == 90.0 and c[1].gob_match_gps.confidence is None and c[1].estimated_gps.gmaps.endswith("12.91000000,80.21000000")


def test_small_pieces(spark, tmp_path):
    for n in (3, 12):
        (tmp_path / f"frame_{n:06d}.jpg").write_bytes(b"picture %d" % n)
    (tmp_path / "frame_x.jpg").write_bytes(b"")
    images = tables.read_images(spark, str(tmp_path))
    assert sorted((r.frame_id, bytes(r.content)) for r in images.collect()) == [(3, b"picture 3"), (12, b"picture 12")]
    assert [r.frame_id for r in tables.missing(spark.createDataFrame([(3,), (4,)], "frame_id long"), images).collect()] == [4]
    assert [r.frame_id for r in tables.only_selected(images, spark.createDataFrame([(12,), (12,)], "frame_id long")).collect()] == [12]
    drawn = sinks.draw(images.selectExpr("frame_id", "length(content) AS n"), lambda r: b"%d" % r.n).collect()
    assert sorted((r.frame_id, bytes(r.picture)) for r in drawn) == [(3, b"9"), (12, b"10")]
    rows = spark.createDataFrame([(7, 1.5, 12.9, 80.2, 10.0)], "frame_id long, timestamp double, latitude double, longitude double, heading_deg double")
    n = timeline.nested_manifest(rows, "/img/", lidar=("a.pcap", "b.pcap")).first()
    assert n.camera_data.path == "/img/frame_000007.jpg" and n.lidar_data.l2 == "b.pcap" and n.ego_pose.heading_deg == 10.0
    filled = select.filled(spark.createDataFrame([(1, None, None, None)], "frame_id long, angle_off_deg double, dist_m double, confidence double")).first()
    assert (filled.angle_off_deg, filled.dist_m, filled.confidence) == (99.0, 999.0, 0.0)
    thin = lidar.thinned(spark.range(10_000).toDF("n"), 100, F.col("n"))
    assert 50 < thin.count() < 200 and lidar.thinned(spark.range(5).toDF("n"), 100, F.col("n")).count() == 5
    dash = spark.createDataFrame([(76, 50.0), (77, 60.0)], "frame_id long, quality_score double")
    cal = spark.createDataFrame([(76, 2.0, True)], "frame_id long, calibrated_error_m double, is_inlier boolean")
    assert [tuple(r) for r in report.dashboard(dash, cal, CURATED_FRAMES).collect()] == [(76, 50.0, 2.0, True)]


def test_depths_of_boxes(spark):
    boxes = spark.createDataFrame([(1, 100.0, 90.0, 119.0, 110.0), (2, 100.0, 90.0, 119.0, 110.0)], "frame_id long, x1 double, y1 double, x2 double, y2 double")
    seen = spark.createDataFrame([(100.0 + i, 100.0, 10.0 + i) for i in range(20)], "u double, v double, depth double")
    got = {r.frame_id: (r.median_depth, r.depth_pts) for r in lidar.depths(boxes, spark.createDataFrame([(1, 7.5, 30)], "frame_id long, depth double, n long"), seen).collect()}
    assert got == {1: (7.5, 30), 2: (pytest.approx(np.percentile([18, 19, 20, 21], 35)), 4)}


def test_matches_of_a_stream(spark, tmp_path):
    from wayfold.plans import views as V

    f, b = V.frames(spark, SF).where("frame_id < 60").withColumn("ts", F.col("ts").cast("timestamp")), V.buildings(spark, SF)
    f.coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = lambda: spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))
    q = events.matched_stream(stream(), b).select("frame_id", "building_id", "score").writeStream.format("memory").queryName("matched").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("matched").collect())) == sorted(map(tuple, match.scored_candidates(f, b).select("frame_id", "building_id", "score").collect()))
    q = events.write_matches(stream(), b, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("frame_id", "building_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, match.best_matches(f, b).select("frame_id", "building_id", "score").collect()))


def test_the_package_ships_itself(tmp_path):
    """A driver in another folder, without PYTHONPATH: workers get the package from it."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from wayfold.shared import ship
ship(spark)
from wayfold.operators import track
f = spark.createDataFrame([(1, k, [(1, 12.9, 80.2, 20.0, 60.0)]) for k in range(5)], "drive_id long, frame_id long, seen array<struct<rank:int,lat:double,lon:double,depth:double,score:double>>")
assert track.stabilised(f).count() == 5
from wayfold.sources import pcap
open({str(tmp_path / "a.pcap")!r}, "wb").close()
assert pcap.read_points(spark, {str(tmp_path / "a.pcap")!r}).count() == 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=tmp_path, env=env)
