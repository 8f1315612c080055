import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import scan, timeline


@pytest.mark.parametrize("ranges", [1, 9])
def test_unwrapped_in_pieces_is_numpys(spark, ranges):
    rng = random.Random(2)
    rows = [(d, float(k), rng.choice([0.0, 90.0, 180.0, 270.0, rng.uniform(-400, 800)])) for d, n in ((1, 4000), (2, 1), (3, 40), (None, 300)) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "drive_id long, t double, yaw double")
    got = {}
    for r in timeline.unwrapped(df, "yaw", "heading", ranges=ranges).collect():
        got.setdefault(r.drive_id, []).append((r.t, r.heading))
    assert set(got) == {1, 2, 3, None}
    for d in got:
        want = np.unwrap([y for _, y in sorted((t, y) for k, t, y in rows if k == d)], period=360)
        assert np.allclose([h for _, h in sorted(got[d])], want, atol=1e-6)
    assert timeline.unwrapped(df.limit(0), "yaw", "heading").count() == 0


def test_null_values_and_clashing_names(spark):
    rows = [(1, float(k), None if k % 5 == 0 else 350.0 if k % 2 else 10.0, "x") for k in range(60)]
    df = spark.createDataFrame(rows, "drive_id long, t double, yaw double, heading_1 string")
    a, b = (sorted(map(tuple, timeline.unwrapped(df, "yaw", "heading", ranges=n).collect()), key=lambda r: r[1]) for n in (1, 7))
    assert a == b and len(a) == 60 and all((r[2] is None) == (r[4] is None) for r in a)


@pytest.mark.parametrize("ranges", [1, 8])
def test_segments_in_pieces(spark, ranges):
    rng = random.Random(3)
    rows = [(d, float(t), k, rng.random()) for d, n in ((1, 900), (2, 1), (3, 2)) for k, t in enumerate(rng.choice([range(n), sorted(rng.randrange(n) for _ in range(n))]))]
    df = spark.createDataFrame(rows, "drive_id long, t double, k long, v double")
    got = sorted(tuple(r) for r in timeline.segments(df, ("v",), tie="k", ranges=ranges).select("drive_id", "t0", "t1", "v_0", "v_1", "last").collect())
    want = []
    for d in (1, 2, 3):
        firsts = {}
        for _, t, k, v in sorted(r for r in rows if r[0] == d):
            firsts.setdefault(t, v)
        at = sorted(firsts)
        want += [(d, x, y, firsts[x], firsts[y], y == at[-1]) for x, y in zip(at, at[1:])]
    assert got == sorted(want)


def test_one_long_drive(spark):
    """All samples are of one drive: poses are those of numpy, and no window is by the drive over its rows."""
    n = 6000
    rng = np.random.default_rng(5)
    t, yaw, lat = np.sort(rng.uniform(0, 1e5, n)), rng.uniform(0, 360, n), rng.uniform(12, 13, n)
    s = spark.createDataFrame([(7, float(a), float(b), float(c), float(c) / 2) for a, b, c in zip(t, yaw, lat)], "drive_id long, t double, yaw double, lat double, lon double").repartition(5)
    f = spark.createDataFrame([(7, k, float(x)) for k, x in enumerate(rng.uniform(-100, 1.001e5, 3000))], "drive_id long, frame_id long, t double")
    u = timeline.unwrapped(s, "yaw", "heading", ranges=12)
    per_piece = scan.pieces(s, "drive_id", ("t",), 12).groupBy("_piece").count().collect()
    assert len(per_piece) > 8 and max(r["count"] for r in per_piece) < 0.3 * n
    got = {r.frame_id: r for r in timeline.interpolated(f, u, ("lat", "heading"), bucket_s=1000.0).collect()}
    turned = np.unwrap(yaw, period=360)
    for r in f.collect():
        k = int(np.clip(np.searchsorted(t, r.t, "right") - 1, 0, n - 2))
        x = (r.t - t[k]) / (t[k + 1] - t[k])
        assert got[r.frame_id].heading == pytest.approx(turned[k] + (turned[k + 1] - turned[k]) * x, abs=1e-6)
        assert got[r.frame_id].lat == pytest.approx(lat[k] + (lat[k + 1] - lat[k]) * x, abs=1e-9)
    m = timeline.manifest(spark.range(1, 200).select(F.lit(7).cast("long").alias("drive_id"), F.col("id").alias("frame_id")), s)
    assert m.count() == 199


def a_drive(rng, n, pauses, still=False):
    """Frames of a vehicle that passes places, seen with noise; still: it stands before one for most of the time."""
    out = []
    for k in range(n):
        at = 12.9 if still and n // 4 < k else 12.9 + k * 4e-6
        if pauses and k % 83 < 6:
            out.append((k, None))
            continue
        first = 12.9 + round((at - 12.9) / 5e-4) * 5e-4
        out.append((k, [(r, first + (r - 1) * 5e-4 + rng.gauss(0, 2e-5), 80.2 + rng.gauss(0, 2e-5), 20 + rng.gauss(0, 3), rng.uniform(40, 90)) for r in range(1, rng.randrange(2, 5))]))
    return out


SEEN = "drive_id long, frame_id long, seen array<struct<rank:int,lat:double,lon:double,depth:double,score:double>>"


def plainly(drive, frames):
    from wayfold.operators.track import Tracks, followed

    return followed(Tracks(), [(k, [s[1:] for s in seen or []]) for k, seen in frames], drive)


@pytest.mark.parametrize(("warm_up", "ranges"), [(200, 1), (200, 10), (5, 12), (0, 6)])
def test_a_drive_without_pauses_in_pieces(spark, warm_up, ranges):
    from wayfold.config import Tracking
    from wayfold.operators import track

    rng = random.Random(11)
    drives = {1: a_drive(rng, 3000, False), 2: a_drive(rng, 500, True), 3: a_drive(rng, 1, False), None: a_drive(rng, 700, False), 5: a_drive(rng, 600, False, still=True), 6: [(k, None) for k in range(20)]}
    df = spark.createDataFrame([(d, k, seen) for d, rows in drives.items() for k, seen in rows], SEEN).repartition(6)
    got = sorted((tuple(r)[:-1] for r in track.stabilised(df, warm_up=warm_up, ranges=ranges).collect()), key=lambda r: (str(r[0]), r[1]))
    want = sorted((r for d, rows in drives.items() for r in plainly(d, rows)), key=lambda r: (str(r[0]), r[1]))
    assert got == want and len({r[2] for r in got if r[0] == 1}) > 10
    _, rounds = track.pieces_run(df.where("drive_id = 1 OR drive_id = 2"), Tracking(), warm_up, ranges)
    assert rounds == 1 if ranges == 1 else rounds <= (2 if warm_up == 200 else ranges)
    assert track.stabilised(df.limit(0), ranges=ranges).count() == 0


def test_pieces_share_the_work_of_one_drive(spark):
    from wayfold.operators import track

    df = spark.createDataFrame([(1, k, seen) for k, seen in a_drive(random.Random(4), 4000, False)], SEEN)
    done, rounds = track.pieces_run(df, track.Tracking(), 200, 8)
    n = [r["count"] for r in done.where("frame_id is not null").groupBy("_piece").count().collect()]
    assert len(n) >= 6 and max(n) <= 3 * sorted(n)[len(n) // 2]
