"""Work for each row that stays small as the tables grow, with the results of the plainer ways."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import wayfold.plans.queries as Q
from wayfold.config import Camera, Grid
from wayfold.functions import geo, polygon, score
from wayfold.operators import calibrate, lidar, match, quantile, select, track
from wayfold.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_are_measured_a_batch_at_once(spark):
    assert "lambda" not in plan(Q.QUERIES["longest_side"](spark, SF))
    rng = random.Random(3)
    place = lambda: (rng.uniform(-179, 179), rng.uniform(-89, 89))
    near = lambda p: (p[0] + rng.uniform(-0.3, 0.3), max(-89.9, min(89.9, p[1] + rng.uniform(-0.3, 0.3))))
    rows = []
    for k in range(60):
        ring = [place()]
        ring += [rng.choice([near(ring[0]), ring[0]]) for _ in range(k % 6)]
        rows.append((k, "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + "))"))
    rows += [(100, None), (101, ""), (102, "1 2 3"), (103, "1 2 1 2"), (104, "1 2 3 4 5"), (105, "1 2 1e999 4")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: r.m for r in df.select("k", polygon.longest_side_m(F.col("t")).alias("m")).collect()}
    pairs = df.select("k", F.posexplode(polygon.number_pairs(F.col("t"))).alias("i", "p"))
    sides = pairs.alias("a").join(pairs.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.i") + 1 == F.col("b.i")))
    m = geo.geodesic_m(F.col("a.p.lat"), F.col("a.p.lon"), F.col("b.p.lat"), F.col("b.p.lon"))
    want = {r.k: r.m for r in sides.groupBy("a.k").agg(F.max(m).alias("m")).collect()}
    assert len(want) > 50 and {k for k, x in got.items() if x is not None} == set(want)
    assert all(got[k] == pytest.approx(x, rel=1e-9, abs=1e-6) or math.isnan(got[k]) and math.isnan(x) for k, x in want.items())


def test_sightings_are_matched_once_for_clusters(spark):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = [(k, 12.9 + (k * 7 % 40) * 1e-4, 80.2 + (k * 3 % 11) * 1e-4) for k in range(300)]
    df = spark.createDataFrame(rows, "frame_id long, b_lat double, b_lon double")
    got = select.leader_clusters(df.mapInArrow(counted, df.schema))
    assert got.count() == 300 and computed.value == 300


def test_detections_out_of_reach_are_not_assigned(monkeypatch):
    class Plain(track.Tracks):
        def _meets(self, seen):
            return bool(self.tracks and seen)

    calls = []
    real = track.assigned
    monkeypatch.setattr(track, "assigned", lambda cost: calls.append(cost) or real(cost))
    far = [(k, [(12.9 + 0.01 * (k % 5), 80.2 + 0.01 * j, 20.0, 60.0 - j) for j in range(4)]) for k in range(40)]
    assert all(r[2:] for r in track.followed(track.Tracks(), far, 1)) and not [c for c in calls if min(map(min, c)) > 18]

    rng = random.Random(7)
    for spread in (3e-5, 3e-4, 1e-3):
        some = lambda: [(-35 + rng.gauss(0, spread), 80 + rng.gauss(0, spread), rng.uniform(5, 50), rng.uniform(30, 90)) for _ in range(rng.randint(0, 4))]
        frames = [(k, sorted(some(), key=lambda d: -d[3])) for k in range(150)]
        calls.clear()
        assert track.followed(track.Tracks(), frames, 1) == track.followed(Plain(), frames, 1)
        assert calls


def test_errors_of_a_grid_leave_their_task_finished(spark):
    rng = random.Random(4)
    spot = lambda: (80.0 + rng.gauss(0, 4e-4), 12.9 + rng.gauss(0, 4e-4))
    rows = []
    for k in range(40):
        points = [spot() for _ in range([0, 2, 3, 5, 9][k % 5])]
        x, y = spot()
        rows.append([k, y, x, rng.uniform(0, 360), rng.uniform(-10, 30), *spot()[::-1], points if k % 10 else None])
    rows[2][3] = rows[3][4] = rows[4][1] = rows[5][5] = rows[6][5] = None
    records = spark.createDataFrame([tuple(r) for r in rows], f"frame_id long, lat double, lon double, heading double, depth double, b_lat double, b_lon double, points {polygon.POINTS}")
    g = Grid(along_start=3.0, along_step=7.0, along_n=6, cross_start=-5.0, cross_step=2.0, cross_n=6)
    e = calibrate.grid_errors(records, g)
    assert "Aggregate" not in plan(e)  # before, a row for each edge was aggregated, and each error exchanged
    r = records.join(calibrate.grid(spark, g))
    want = {(x.cell, x.frame_id): x for x in r.select("cell", "frame_id", "along", "cross", calibrate.offset_error(F.col("along"), F.col("cross")).alias("err")).collect()}
    got = e.collect()
    assert len(got) == len(want) == 40 * 36
    assert sum(x.err == 0 for x in got) > 20
    for x in got:
        w = want[x.cell, x.frame_id]
        assert (x.along, x.cross) == (w.along, w.cross)
        assert x.err == pytest.approx(w.err, abs=1e-6)


def test_errors_of_a_grid_are_counted_where_they_are(spark, monkeypatch):
    rng = random.Random(6)
    spot = lambda: (80.0 + rng.gauss(0, 2e-4), 12.9 + rng.gauss(0, 2e-4))
    rows = []
    for k in range(500):
        points = [spot() for _ in range([0, 2, 3, 5, 9][k % 5])]
        x, y = spot()
        rows.append([k, y, x, rng.uniform(0, 360), rng.uniform(-10, 30), *spot()[::-1], points if k % 10 else None])
    rows[2][3] = rows[3][4] = rows[4][1] = rows[5][5] = None
    rows += [[1000 + k, *rows[7][1:]] for k in range(100)]  # ties
    records = spark.createDataFrame([tuple(r) for r in rows], f"frame_id long, lat double, lon double, heading double, depth double, b_lat double, b_lon double, points {polygon.POINTS}")
    g = Grid(along_start=3.0, along_step=7.0, along_n=2, cross_start=-5.0, cross_step=4.0, cross_n=2)
    written = []
    with monkeypatch.context() as m:
        m.setattr(Q, "_GRID", g)
        m.setattr(Q, "_curated", lambda spark, d: records)
        for module in (calibrate, quantile):
            m.setattr(module, "cut", lambda df, real=module.cut: written.append(real(df)) or written[-1])
        got = {r.cell: r for r in Q.grid_search(spark, "").collect()}
    assert max(w.count() for w in written) <= 600  # of 2,400 errors; before, each was written
    e = {}
    for r in records.join(calibrate.grid(spark, g)).select("cell", "along", "cross", calibrate.offset_error(F.col("along"), F.col("cross")).alias("err")).collect():
        e.setdefault(r.cell, []).append(r.err)
    assert set(got) == set(e)
    for cell, errors in e.items():
        inliers = [x for x in errors if x <= max(2 * statistics.median(errors), 4.5)]
        assert (got[cell].mean, got[cell]["median"]) == (pytest.approx(statistics.fmean(inliers), abs=6e-4), pytest.approx(statistics.median(inliers), abs=6e-4))
        assert got[cell].inside == inliers.count(0) > 0
    plain = calibrate.grid_scores(calibrate.grid_errors(records, g), g).orderBy("cell").collect()
    for a, b in zip(plain, calibrate.grid_totals(records, g).orderBy("cell").collect(), strict=True):
        assert (a.cell, a.along, a.cross, a["median"], a.inside) == (b.cell, b.along, b.cross, b["median"], b.inside) and a["mean"] == pytest.approx(b["mean"], rel=1e-12)
    assert calibrate.grid_totals(records.limit(0), g).count() == 0


def test_pairs_that_cannot_reach_a_score_are_left(spark, monkeypatch):
    f, b = V.frames(spark, SF), V.buildings(spark, SF)
    f = f.withColumn("depth", F.expr("CASE frame_id % 9 WHEN 0 THEN NULL WHEN 1 THEN -depth ELSE depth END"))
    best = match.best_matches(f, b).drop("n_candidates").cache()
    real, seen = match.cone_candidates, []
    monkeypatch.setattr(match, "cone_candidates", lambda *a: seen.append(real(*a)) or seen[-1])
    for least in (50.0, 60.0, 75.0):
        got = match.best_matches(f, b, min_score=least)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, best.where(F.col("score") >= least).collect()), key=str) != []
    assert seen[-1].count() < real(f, b).count() / 10
    rng = random.Random(3)
    rows = [(rng.uniform(0, 35), rng.choice([0.0, rng.uniform(0, 150)]), rng.choice([None, 0.0, rng.uniform(0, 40)]), rng.uniform(0, 1), rng.choice([None, -1.0, 0.0, rng.uniform(1, 80)])) for _ in range(2000)]
    r = spark.createDataFrame(rows, "off double, dist double, width double, frac double, depth double")
    t = r.select(score.match_terms(*(F.col(c) for c in r.columns)).alias("t"), score.match_bound(F.col("dist"), F.col("depth")).alias("most"))
    assert t.where("t.angle + t.prox + t.width + t.depth > most + 1e-9").count() == 0


def test_points_are_projected_once(spark):
    points = V.points(spark, SF)
    seen = lidar.projected(points)
    camera = Camera()
    assert plan(seen).count(str(camera.from_lidar[2][0])) <= 2  # before, each condition had the whole expression
    assert seen.columns == [*points.columns, "u", "v", "depth"]
    got = {(r.tile, r.n): (r.u, r.v, r.depth) for r in seen.collect()}
    want = {}
    for r in points.collect():
        x, y, z = (m[0] * r.x + m[1] * r.y + m[2] * r.z + m[3] for m in camera.from_lidar)
        if 1.5 < z < 80 and abs(x) < 50 and -1.5 < y < 12:
            u, v = camera.fx * x / z + camera.cx, camera.fy * y / z + camera.cy
            if 0 <= u < camera.width and 0 <= v < camera.height:
                want[r.tile, r.n] = u, v, z
    assert got == want and 0 < len(got) < points.count()
    behind = spark.createDataFrame([(0.0, 0.0, 0.0), (5.0, 0.0, 0.0)], "x double, y double, z double").withColumn("depth", F.lit(1.0))
    flat = Camera(from_lidar=((0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0)))
    assert [(r.x, r.depth) for r in lidar.projected(behind, flat).collect()] == [(5.0, 5.0)]  # nothing is divided by a depth of 0
