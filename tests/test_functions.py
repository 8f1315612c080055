import math
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.functions import basic, geo, polygon, score
from wayfold.operators.track import Tracks, assigned, metres
from wayfold.plans import queries as Q
from wayfold.plans import sql as S


def test_distances_and_bearings(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(*r) for r in ((-80, 80), (-170, 170), (-80, 80), (-170, 170))) for _ in range(200)] + [(1.0, 2.0, 1.0, 2.0)]
    c = [F.col(x) for x in "abcd"]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(
        *c, geo.haversine_m(*c).alias("m"), geo.haversine_m(c[2], c[3], c[0], c[1]).alias("back"), geo.bearing_deg(*c).alias("br"), geo.angle_diff_deg(c[0], c[1]).alias("df")
    )
    for r in got.collect():
        assert math.isclose(r.m, metres(r.a, r.b, r.c, r.d), rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.m, r.back, rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.br < 360 and math.isclose(r.df, abs((r.a - r.b + 180) % 360 - 180), abs_tol=1e-9)


def test_geodesics(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-70, 70), rng.uniform(-179, 179), rng.uniform(0, 360), rng.choice([0.0, 1.0, 80.0, 5e4, 2e6])) for _ in range(200)]
    c = [F.col(x) for x in "abcd"]
    p = spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", geo.destination(*c).alias("p"))
    for r in p.select("*", geo.geodesic_m(c[0], c[1], F.col("p.lat"), F.col("p.lon")).alias("m")).collect():
        assert abs(r.m - r.d) < 1e-4
    one = spark.range(1).select(geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e"), geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("q")).first()
    assert abs(one.e - math.pi * 6378137 / 180) < 1e-3 and abs(one.q - 10_001_965.729) < 1e-2


def test_destinations_are_those_of_sql_to_the_last_bit(spark):
    rng = random.Random(6)
    rows = [(rng.uniform(-70, 70), rng.uniform(-179, 179), rng.uniform(0, 360), rng.uniform(0, 80)) for _ in range(2000)]
    got = spark.createDataFrame(rows, "lat double, lon double, heading double, depth double").select(geo.destination(*(F.col(c) for c in ("lat", "lon", "heading", "depth"))).alias("p")).select("p.*").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, lat DOUBLE, lon DOUBLE, heading DOUBLE, depth DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(k, *r) for k, r in enumerate(rows)])
    want = con.execute(f"SELECT p.lat, p.lon FROM (SELECT id, {S.destination('lat', 'lon', 'heading', 'depth')} AS p FROM t) ORDER BY id").fetchall()
    assert [tuple(r) for r in got] == want
    odd = [(None, 1.0, 2.0, 3.0), (1.0, None, 2.0, 3.0), (1.0, 2.0, 3.0, None), (1.0, 2.0, math.inf, 3.0)]
    got = spark.createDataFrame(odd, "a double, b double, c double, d double").select(geo.destination(*(F.col(c) for c in "abcd")).alias("p")).select("p.*").collect()
    assert [tuple(map(str, r)) for r in got] == [("None", "None"), (str(got[1].lat), "None"), ("None", "None"), ("nan", "nan")] and got[1].lat > 1


def test_targets_next_to_a_tie_are_those_of_sql(spark, tmp_path):
    spark.sql("SELECT 3119909L AS event_id, 1L AS user_id, current_timestamp() AS ts").write.parquet(f"{tmp_path}/events.parquet")
    r = Q.QUERIES["target_points"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r)] == con.execute(Q.ORACLES["target_points"]).fetchall()


def test_rounding_is_pythons(spark):
    rng = random.Random(4)
    xs = [2.675, 0.125, 0.375, -2.5, 1.005, 0.0, -0.125] + [round(rng.uniform(-99, 99), 3) for _ in range(3000)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", basic.round_exact(F.col("x"), 2).alias("r")).collect():
        assert r.r == round(r.x, 2)


def test_polygons(spark):
    rows = [
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 1.0, 1.0), ("polygon((0 0,4 0,4 4,0 4,0 0))", 5.0, 2.0), ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", 1.0, 3.0),
        ("MULTIPOLYGON(((0 0, 4 0, 4 4, 0 0)), ((9 9, 8 8, 7 9, 9 9)))", 3.0, 1.0), ("0 0 4 0 4 4", 1.0, 3.0), ("", 1.0, 1.0), (None, 1.0, 1.0), ("POLYGON((0 0, x 1, 1 1))", 0.0, 0.0),
    ]
    p = polygon.polygon_points(F.col("w"))
    got = spark.createDataFrame(rows, "w string, lat double, lon double").select(F.size(p).alias("n"), polygon.contains(p, F.col("lat"), F.col("lon")).alias("i"), polygon.edge_error_m(F.col("lat"), F.col("lon"), p).alias("e"), polygon.geometry_status(F.col("w")).alias("s")).collect()
    assert [r.n for r in got] == [5, 5, 5, 4, 3, 0, 0, 2]
    assert [r.i for r in got][:5] == [True, False, True, False, True]
    assert got[0].e == 0 and abs(got[1].e - 111_195) < 60 and got[5].e is None and got[7].e is None
    assert [r.s for r in got] == ["simple", "simple", "holes", "multi", "text", "none", "none", "simple"]


def test_scores_and_labels(spark):
    t = score.match_terms(*(F.col(c) for c in ("off", "dist", "w", "frac", "depth")))
    rows = [(5.0, 10.0, 8.0, 0.3, 12.0), (40.0, 0.0, 8.0, 0.3, None), (0.0, 3.0, None, 0.3, 0.0)]
    got = spark.createDataFrame(rows, "off double, dist double, w double, frac double, depth double").select(t.alias("t")).collect()
    hfov = math.degrees(2 * math.atan2(1920, 1106.46))
    e = 2 * math.degrees(math.atan2(4, 10)) / hfov
    assert math.isclose(got[0].t.angle, 50 * (1 - (5 / 35) ** 1.6)) and math.isclose(got[0].t.prox, 30 * math.exp(-2)) and math.isclose(got[0].t.width, 15 * min(0.3, e) / max(0.3, e)) and math.isclose(got[0].t.depth, 10 * math.exp(-2 / 15))
    assert got[1].t.angle == 0 and got[1].t.width == 0 and got[1].t.depth == 0 and got[2].t.width == 0
    labels = spark.createDataFrame([(x,) for x in (None, 0.0, 2.9, 3.0, 9.9, 19.9, 20.0)], "e double").select(score.accuracy_label(F.col("e")).alias("l")).collect()
    assert [r.l for r in labels] == ["unknown", "INSIDE", "sub-3m", "excellent", "good", "fair", "poor"]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.integers(1, 4).flatmap(lambda m: st.lists(st.lists(st.integers(0, 30), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_the_cheapest(cost):
    from itertools import permutations

    n, m = len(cost), len(cost[0])
    got = assigned(cost)
    assert len(got) == min(n, m) == len(set(got.values()))
    if n >= m:
        best = min(sum(cost[r][c] for c, r in enumerate(rows)) for rows in permutations(range(n), m))
    else:
        best = min(sum(cost[r][c] for r, c in enumerate(cols)) for cols in permutations(range(m), n))
    assert sum(cost[r][c] for r, c in got.items()) == best


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.integers(1, 4).flatmap(lambda m: st.lists(st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.3, 1.0]), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_of_equal_costs(cost):
    """Of all the cheapest matchings, by exact sums, that which gives the first rows the lowest columns."""
    from fractions import Fraction
    from itertools import permutations

    n, m = len(cost), len(cost[0])
    ways = [dict(enumerate(p)) for p in permutations(range(m), n)] if n <= m else [{r: c for c, r in enumerate(p)} for p in permutations(range(n), m)]
    total = lambda w: sum(Fraction(cost[r][c]) for r, c in w.items())
    least = min(map(total, ways))
    assert assigned(cost) == dict(sorted(min((w for w in ways if total(w) == least), key=lambda w: [w.get(r, m) for r in range(n)]).items()))


def test_assignment_of_many():
    import time

    rng = random.Random(2)
    for n, m in ((30, 30), (60, 20), (5, 200)):
        began = time.time()
        got = assigned([[rng.uniform(0, 50) for _ in range(m)] for _ in range(n)])
        assert len(got) == min(n, m) == len(set(got.values())) and time.time() - began < 1
    assert assigned([]) == assigned([[]]) == {} and assigned([[float("nan"), 3.0], [1.0, 2.0]]) == {0: 1, 1: 0}


def test_tracks():
    t = Tracks()
    assert t.frame((13.0, 80.0, 20.0, 44.9), []) is None and not t.tracks  # below the gate
    assert t.frame((13.0, 80.0, 20.0, 47.0), []) is None and not t.tracks  # too weak to begin a track
    row = t.frame((13.0, 80.0, 20.0, 60.0), [])
    assert row[0] == 1 and row[7] is True and row[11] == 0.0  # one hit is provisional
    row = t.frame((13.00001, 80.0, 20.0, 60.0), [])
    assert row[0] == 1 and row[7] is False and row[4] == 2 and 0 < row[11] < 1.2
    for _ in range(3):
        assert t.frame(None, []) is None
    assert t.frame(None, []) is None and not t.tracks  # missed four times
    again = Tracks(state=t.state())
    assert again.frame((13.0, 80.0, 20.0, 60.0), [])[0] == 2


def matrix_filter(drive):
    """The published filter over place, depth and speed of place as one five-state matrix filter, with the same life of tracks, in plain numpy."""
    import numpy as np

    from wayfold.config import Tracking

    s = Tracking()
    move, see = np.eye(5), np.eye(3, 5)
    move[0, 3] = move[1, 4] = 1.0
    start = np.diag([4.5e-5**2, 4.5e-5**2, 8.0**2, 5e-7**2, 5e-7**2])
    drift = np.diag([3e-7**2, 3e-7**2, 0.1**2, 1e-8**2, 1e-8**2])
    noise = np.diag([3.5e-5**2, 3.5e-5**2, 6.0**2])
    tracks, next_id, out = [], 1, []
    for frame, seen in drive:
        usable = [] if not seen or seen[0][3] < s.gate else [seen[0], *(d for d in seen[1:] if d[3] >= s.min_update)]
        for t in tracks:
            t["x"], t["P"] = move @ t["x"], move @ t["P"] @ move.T + drift
            t["age"], t["missed"] = t["age"] + 1, t["missed"] + 1
        taken = set()
        if tracks and usable:
            cost = [[metres(t["x"][0], t["x"][1], d[0], d[1]) for d in usable] for t in tracks]
            for r, c in assigned(cost).items():
                if cost[r][c] > s.reach_m:
                    continue
                taken.add(c)
                lat, lon, depth, points = usable[c]
                if points < s.min_update:
                    continue
                t, scale = tracks[r], max(0.4, min(2.5, 100 / max(points, 10.0)))
                gain = t["P"] @ see.T @ np.linalg.inv(see @ t["P"] @ see.T + noise * scale)
                t["x"] = t["x"] + gain @ (np.array([lat, lon, depth]) - see @ t["x"])
                t["P"] = (np.eye(5) - gain @ see) @ t["P"]
                t["hits"], t["missed"], t["points"] = t["hits"] + 1, 0, [*t["points"], points][-5:]
        for c, (lat, lon, depth, points) in enumerate(usable):
            if c not in taken and points >= s.min_start:
                tracks.append({"id": next_id, "x": np.array([lat, lon, depth, 0, 0]), "P": start.copy(), "hits": 1, "missed": 0, "age": 0, "points": [points]})
                next_id += 1
        tracks = [t for t in tracks if t["missed"] <= s.max_misses]
        if not usable:
            continue
        lat, lon = usable[0][:2]
        gap = lambda t: metres(t["x"][0], t["x"][1], lat, lon)  # noqa: E731, B023
        sure = [t for t in tracks if t["hits"] >= s.min_hits]
        shown = sure or sorted((t for t in tracks if gap(t) <= s.cap_m), key=gap)[:1]
        if not shown:
            continue
        t = max(shown, key=lambda t: 10 * t["hits"] + sum(t["points"]) / len(t["points"]) - 0.1 * gap(t))
        at = (lat, lon) if gap(t) > s.cap_m else tuple(t["x"][:2])
        out.append((frame, t["id"], *at, t["x"][2], t["hits"], t["age"], not sure))
    return out


def test_tracks_are_those_of_a_matrix_filter(spark):
    from wayfold.operators import match, track
    from wayfold.plans import views as V

    d = "/root/testdata/sf0.001"
    f = track.frame_candidates(V.frames(spark, d), match.ranked(match.scored_candidates(V.frames(spark, d), V.buildings(spark, d)), 4))
    # the table's drives are thin; one more goes back and forth past a few places, with pauses
    rng = random.Random(6)
    more = []
    for k in range(900):
        if k % 97 < 6 or rng.random() < 0.1:
            more.append((10**6, k, None))
        else:
            at = 12.9 + abs(k % 120 - 60) * 2e-5
            more.append((10**6, k, [(r, at + rng.gauss(0, 2e-5) + r * 1e-4, 80.2 + rng.gauss(0, 2e-5), 20 + rng.gauss(0, 3), rng.uniform(30, 90)) for r in range(1, rng.randrange(2, 5))]))
    f = f.unionByName(spark.createDataFrame(more, f.schema))
    drives = {}
    for r in f.collect():
        drives.setdefault(r.drive_id, []).append((r.frame_id, [(s["lat"], s["lon"], s["depth"], s["score"]) for s in r.seen or []]))
    expected = sorted((drive, *row) for drive, rows in drives.items() for row in matrix_filter(sorted(rows, key=lambda x: x[0])))
    got = sorted((r.drive_id, r.frame_id, r.track_id, r.stable_lat, r.stable_lon, r.stable_depth, r.track_hits, r.track_age, r.provisional) for r in track.stabilised(f).collect())
    assert len(got) == len(expected) > 500 and max(r[2] for r in got) > 20
    for a, b in zip(got, expected, strict=True):
        assert (*a[:3], *a[6:]) == (*b[:3], *b[6:])
        assert abs(a[3] - b[3]) < 1e-9 and abs(a[4] - b[4]) < 1e-9 and abs(a[5] - b[5]) < 1e-6


def test_times(spark):
    rows = spark.createDataFrame([("2024-05-03T07:08:09",), ("no time",), (None,)], "t string")
    got = rows.select(basic.time_label(F.col("t")).alias("l"), basic.iso_text(F.col("t").try_cast("timestamp")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("03 May 2024  07:08", "2024-05-03T07:08:09"), ("no time", None), (None, None)]


def test_numbers(spark):
    got = spark.createDataFrame([("1 -2.5,+3. .5e1;x7E-1y 8", )], "w string").select(polygon.number_pairs(F.col("w")).alias("p")).first().p
    assert [(p.lon, p.lat) for p in got] == [(1.0, -2.5), (3.0, 5.0), (0.7, 8.0)]


def test_change(spark):
    rows = spark.createDataFrame([(10.0, 5.0), (10.0, 15.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r.t for r in rows.select(score.change_text(F.col("a"), F.col("b")).alias("t")).collect()] == ["50% better", "50% worse", None, None]
