from pyspark.sql import functions as F

from wayfold.config import Grid
from wayfold.operators import calibrate, match, report, select
from wayfold.sources import sinks

SQUARE = "POLYGON((80.0 12.0, 80.0002 12.0, 80.0002 12.0002, 80.0 12.0002, 80.0 12.0))"


def sightings(spark):
    rows = [(1, 5, 12.0001, 80.0001, 80.0, 3.0, 20.0, 0.9, 4, SQUARE), (2, 5, 12.0001, 80.0001, 85.0, 3.0, 20.0, 0.9, 4, SQUARE), (3, 6, 12.1, 80.1, 60.0, 10.0, 30.0, None, 2, ""), (4, 7, 12.2, 80.2, 1.0, 34.0, 149.0, 0.1, 1, None)]
    return spark.createDataFrame(rows, "frame_id long, building_id long, b_lat double, b_lon double, score double, angle_off_deg double, dist_m double, confidence double, n_candidates int, geometry string")


def test_select_best_with_targets(spark, tmp_path):
    t = spark.createDataFrame([(2, 12.0, 80.0, 12.0001, 80.0001, 5.0), (3, 12.1, 80.1, 12.1001, 80.1, 9.0)], "frame_id long, ego_lat double, ego_lon double, target_lat double, target_lon double, heading_deg double")
    best = select.select_best(select.leader_clusters(sightings(spark)), t)
    got = best.collect()
    assert [r.frame_id for r in got] == [2, 3]  # the third is under the least quality
    assert got[0].cluster_size == 2 and got[0].smoothing_method == "polygon_centroid" and got[0].error_m == 0.0 and "near-perfect heading" in got[0].why_selected
    assert got[1].smoothing_method == "weighted_mean" and abs(got[1].error_m - 11.12) < 0.01 and "edge-error=11.1 m" in got[1].why_selected
    dash = report.dashboard(best, spark.createDataFrame([(3, 1.5, True)], "frame_id long, calibrated_error_m double, is_inlier boolean"))
    layers = {(r.frame_id, r.layer): r.radius_m for r in report.map_layers(dash).collect()}
    assert layers == {(2, "ego"): None, (3, "ego"): None, (2, "building"): 0.0, (3, "building"): 1.5}
    assert report.kpis(dash).first().buildings == 2
    sinks.write_report(select.report_lines(best), str(tmp_path / "r"), "Selected buildings")
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[0] == "Selected buildings" and len(lines) == 3


def test_ranked_and_nested(spark):
    c = spark.createDataFrame([(1, 9, 50.0), (1, 3, 50.0), (1, 4, 60.0), (2, 1, 10.0)], "frame_id long, building_id long, score double")
    n = {r.frame_id: r for r in sinks.nested_matches(match.ranked(c), 2).collect()}
    assert n[1].best_match.building_id == 4 and [x.building_id for x in n[1].all_candidates] == [4, 3] and len(n[2].all_candidates) == 1


def test_a_search_that_stops_early(spark):
    rows = [(0, 25.0, -6.0, 9.0, 9.0, 0), (1, 25.0, -5.8, 2.0, 2.5, 1), (2, 25.0, -5.6, 1.0, 1.0, 2), (3, 25.0, -5.4, 4.0, 4.0, 0)]
    s = spark.createDataFrame(rows, "cell long, along double, cross double, mean double, median double, inside long")
    early, whole = calibrate.running_best(s).first(), calibrate.running_best(s, stop_early=False).first()
    assert (early.cell, early.stopped_at, early.met) == (1, 1, True) and (whole.cell, whole.stopped_at) == (2, 3)
    assert calibrate.running_best(s.where("cell in (0, 3)")).first().met is False
    g = calibrate.grid(spark, Grid()).agg(F.count("*").alias("n"), F.max("along").alias("a"), F.max("cross").alias("c")).first()
    assert (g.n, g.a, round(g.c, 9)) == (3600, 54.5, 5.8)


def test_offsets_of_one_record(spark):
    r = sightings(spark).where("frame_id = 1").withColumns({"raw_lat": F.lit(12.0), "raw_lon": F.lit(80.0)})
    o = calibrate.mean_offsets(r)
    assert o.first().std_dlat == 0.0 and abs(o.first().lat_m - 11.132) < 1e-6
    e = calibrate.evaluated(r, o).first()
    assert e.corrected_error_m == 0.0 and e.accuracy_label == "INSIDE"
