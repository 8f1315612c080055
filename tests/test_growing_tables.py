"""Steps that grow with the tables, whatever size Spark takes a file for."""

import random

import pytest
from pyspark.sql import functions as F

import wayfold.plans.queries as Q
from wayfold.functions import polygon
from wayfold.operators import calibrate, lidar, match, quantile, report
from wayfold.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_match_is_broadcast(spark):
    f, b = V.frames(spark, SF), polygon.with_outlines(V.buildings(spark, SF))
    assert "Broadcast" not in plan(match.best_matches(f, b))
    homes = match._homes(f, 150.0)
    assert homes.count() == f.count()  # so all pairs of a frame are in one task, and exchanged aggregated


def spied(monkeypatch, module, name, seen):
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])


@pytest.mark.parametrize("name", ["calibration_record", "tracker_record"])
def test_records_of_tables_are_not_nested_in_a_row(spark, monkeypatch, name):
    def refused(*a, **k):
        raise AssertionError("lines in one row")

    for module in (calibrate, report):
        monkeypatch.setattr(module, "nested", refused)
    r = Q.QUERIES[name](spark, SF).first()
    assert r[0] > 100 and r[1] > 10


@pytest.mark.parametrize("name", ["kpis", "dashboard_join"])
def test_frames_are_matched_once(spark, monkeypatch, name):
    seen = []
    spied(monkeypatch, match, "best_matches", seen)
    assert Q.QUERIES[name](spark, SF).count() > 0 and len(seen) == 1


def test_boxes_gather_the_points_that_count(spark, monkeypatch):
    rng = random.Random(5)
    points = [(rng.uniform(0, 300), rng.uniform(0, 200), rng.uniform(1, 90)) for _ in range(3000)]
    boxes = [(k, x, y, x + rng.choice([0, 4, 30, 90]), y + rng.choice([-5, 3, 40, 80])) for k in range(40) for x, y in [(rng.uniform(-50, 280), rng.uniform(-30, 180))]]
    seen = []
    spied(monkeypatch, lidar, "_in_regions", seen)
    got = {r.frame_id: (r.depth, r.n) for r in lidar.box_depth(spark.createDataFrame(boxes, "frame_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(points, "u double, v double, depth double"), bucket_px=16).collect()}
    used = 0
    for k, x1, y1, x2, y2 in boxes:
        box = sorted(d for u, v, d in points if x1 <= u <= x2 and y1 <= v <= y2 and 2 < d < 80)
        strip = sorted(d for u, v, d in points if abs(u - (x1 + x2) / 2) <= (x2 - x1) * 0.1 and abs(v - (y1 + y2) / 2) <= (y2 - y1) * 0.3 and 2 < d < 80)
        of = next((s for s in (strip, box) if len(s) > 3), [])
        used += len(strip) + (len(box) if len(strip) <= 3 else 0)
        assert got[k][1] == len(of)
        if of:
            p = (len(of) - 1) * 0.35
            assert got[k][0] == pytest.approx(of[int(p)] + (p - int(p)) * (of[min(int(p) + 1, len(of) - 1)] - of[int(p)]))
    assert sum(s.count() for s in seen) == used


def test_pairs_of_boxes_and_points_are_not_written(spark, monkeypatch):
    rng = random.Random(7)
    points = [(rng.uniform(0, 300), rng.uniform(0, 200), rng.choice([5.0, 7.25, rng.uniform(2, 80), rng.gauss(30, 1e-6)])) for _ in range(1500)] * 4
    boxes = [(k, 100.0 - k, 100.0 - k, 200.0 + k, 120.0 + k) for k in range(60)] + [(90, -9.0, -9.0, 400.0, 400.0), (91, 500.0, 0.0, 600.0, 10.0), (92, None, 0.0, 600.0, 10.0)]
    written = []
    for module in (lidar, quantile):
        spied(monkeypatch, module, "cut", written)
    df = lidar.box_depth(spark.createDataFrame(boxes, "frame_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(points, "u double, v double, depth double"))
    got = {r.frame_id: (r.depth, r.n) for r in df.collect()}
    counts = [w.count() for w in written]
    assert counts[0] <= 1500 and max(counts[1:]) <= len(boxes)
    counted = sorted(d for *_, d in points if 2 < d < 80)

    def percentile(of, p):
        at = (len(of) - 1) * p
        return pytest.approx(of[int(at)] + (at - int(at)) * (of[min(int(at) + 1, len(of) - 1)] - of[int(at)]), rel=1e-12)

    for k, x1, y1, x2, y2 in boxes[:-2]:
        strip = sorted(d for u, v, d in points if abs(u - (x1 + x2) / 2) <= (x2 - x1) * 0.1 and abs(v - (y1 + y2) / 2) <= (y2 - y1) * 0.3 and 2 < d < 80)
        box = sorted(d for u, v, d in points if x1 <= u <= x2 and y1 <= v <= y2 and 2 < d < 80)
        of = strip if len(strip) > 3 else box
        assert got[k] == (percentile(of, 0.35), len(of))
    assert got[91] == got[92] == (percentile(counted, 0.4), 0)


@pytest.mark.parametrize("last", [0, 256])
def test_percentiles_of_joins_are_exact(spark, monkeypatch, last):
    """last 0: rounds of slices alone; groups of ties, of one value, of neighbouring doubles, at the bounds."""
    monkeypatch.setattr(quantile, "LAST", last)
    rng = random.Random(9)
    values = {1: [5.0], 2: [5.0] * 9, 3: [2.0, 80.0], 4: [rng.choice([3.0, 4.0]) for _ in range(500)], 5: [rng.uniform(2, 80) for _ in range(3000)], 6: [30 + k * 4e-15 for k in range(700)], 7: [2.0] * 300 + [80.0] * 300, 8: [1 / k for k in range(1, 900)]}
    rows = spark.createDataFrame([(k, x, 1) for k, xs in values.items() for x in xs], "k long, value double, times long")
    groups = spark.createDataFrame([(k,) for k in [*values, 99]], "k long")
    for p in (0.0, 0.35, 0.5, 1.0):
        got = {r.k: (r.x, r.n) for r in quantile.met_percentile(groups, rows, lambda g: rows.join(g, "k"), "k", p, 0.0, 80.0).collect()}
        want = {r.k: (r.x, r.n) for r in rows.groupBy("k").agg(F.percentile("value", p).alias("x"), F.count("*").alias("n")).collect()}
        assert got == want


def test_places_are_written_by_their_exact_values(spark):
    values = [80 + (2 * k + 1) * 5e-9 for k in range(400)] + [-12.345678905, 1e-9, -3.0, 4.5e7]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(Q.geo.map_url(F.col("x"), F.col("x"), "").alias("t"), Q.basic.round_scaled(F.col("x"), 8).alias("r")).collect()
    assert [r.t for r in got] == [f"{x:.8f},{x:.8f}" for x in values]
    away = lambda x: (1 if x >= 0 else -1) * int(abs(x * 1e8) + 0.5) / 1e8
    assert [r.r for r in got] == [away(x) for x in values]


def test_contained_is_by_the_rule_of_contains(spark):
    rng = random.Random(8)
    ring = lambda n: [(round(rng.uniform(0, 1), 2), round(rng.uniform(0, 1), 2)) for _ in range(n)]
    rows = [(k, ring(n) if n is not None else None) for k, n in enumerate([None, 0, 1, 2, 3, 4, 5, 7, 9] * 4)]
    frames = spark.createDataFrame([(k, round(rng.uniform(-0.2, 1.2), 2), round(rng.uniform(-0.2, 1.2), 2)) for k in range(300)], "frame_id long, lat double, lon double")
    b = spark.createDataFrame(rows, f"building_id long, points {polygon.POINTS}")
    want = frames.crossJoin(b).groupBy("frame_id").agg(F.count_if(polygon.contains(F.col("points"), F.col("lat"), F.col("lon"))).alias("inside"))
    assert sorted(polygon.contained(frames.crossJoin(polygon.with_edges(b))).collect()) == sorted(want.collect())


def test_dear_functions_of_a_small_file_go_over_all_tasks(spark):
    assert Q.QUERIES["longest_side"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
