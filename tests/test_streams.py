import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import track
from wayfold.streaming import tracker

SEEN = "drive_id long, frame_id long, seen array<struct<rank:int,lat:double,lon:double,depth:double,score:double>>"


def drives(n=60):
    rng = random.Random(5)
    out = []
    for drive in (1, 2, 3):
        for k in range(n):
            seen = None if rng.random() < 0.2 or drive == 3 and k % 11 > 5 else [(1, 12.94 + drive + rng.uniform(0, 2e-5), 80.0, 20.0, rng.uniform(40, 80)), (2, 12.9402 + drive, 80.0, 20.0, rng.uniform(30, 60))]
            out.append((drive, 1000 * drive + k, seen))
    return out


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(drives(), SEEN)


def part(frames, a, b):
    return frames.where((F.col("frame_id") % 1000 >= a) & (F.col("frame_id") % 1000 < b))


def put(frames, path):
    frames.repartition(1).write.mode("append").parquet(path)


def run(spark, src, checkpoint, out, initial=None):
    """All that is there, a file a trigger; the query ends then."""
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(src)
    q = tracker.stabilised_stream(stream, initial=initial).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def rows(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_stream_equals_batch_over_triggers_and_restarts(spark, frames, tmp_path):
    want = sorted(map(tuple, track.stabilised(frames).drop("gmaps").collect()))
    assert len(want) > 80
    src, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    for k in range(3):
        put(part(frames, 10 * k, 10 * k + 10), src)
    run(spark, src, check, out)
    assert 0 < len(rows(spark, out)) < len(want)
    for k in range(3, 6):
        put(part(frames, 10 * k, 10 * k + 10).orderBy(F.desc("frame_id")), src)
    run(spark, src, check, out)  # another query, from the checkpoint
    assert rows(spark, out) == want
    put(part(frames, 20, 25), src)  # late: later ones have been worked off
    run(spark, src, check, out)
    assert rows(spark, out) == want
    state = spark.read.format("statestore").option("stateVarName", "tracks").load(check)
    progress = spark.read.format("statestore").option("stateVarName", "progress").load(check)
    assert state.count() <= 12 and progress.count() == 3  # a few living tracks, and a place for each drive


def test_state_does_not_grow_with_the_drive(spark, tmp_path):
    src, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    long = spark.createDataFrame(drives(600), SEEN)
    for a, b in ((0, 200), (200, 600)):
        put(part(long, a, b), src)
    run(spark, src, check, out)
    assert rows(spark, out) == sorted(map(tuple, track.stabilised(long).drop("gmaps").collect()))
    assert spark.read.format("statestore").option("stateVarName", "tracks").load(check).count() <= 12


def test_goes_on_where_a_batch_run_ended(spark, frames, tmp_path):
    first, rest = part(frames, 0, 35), part(frames, 35, 60)
    initial = track.final_states(first, ranges=4)
    states = {r.drive_id: r for r in initial.collect()}
    assert set(states) == {1, 2, 3} and states[1].last == 1034 and any(r.tracks for r in states.values())
    src, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    put(rest, src)
    run(spark, src, check, out, initial)
    want = [r for r in sorted(map(tuple, track.stabilised(frames).drop("gmaps").collect())) if r[1] % 1000 >= 35]
    assert rows(spark, out) == want


def test_dashboard_of_two_streams_equals_batch(spark, tmp_path):
    from wayfold.streaming import events

    at = lambda k: f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00"
    left = [(k, at(k), k * 1.5) for k in range(0, 600, 3)]
    right = [(k, at(k + (k % 5) * 2 - 4 if k > 10 else k), k / 10, k % 2 == 0) for k in range(0, 600, 2)] + [(9, at(300), 1.0, True)]
    s = spark.createDataFrame(left, "frame_id long, t string, quality_score double").selectExpr("frame_id", "timestamp(t) AS ts", "quality_score")
    c = spark.createDataFrame(right, "frame_id long, t string, calibrated_error_m double, is_inlier boolean").selectExpr("frame_id", "timestamp(t) AS ts", "calibrated_error_m", "is_inlier")
    for name, df in (("s", s), ("c", c)):
        for a in range(0, 600, 200):
            df.where((F.col("frame_id") >= a) & (F.col("frame_id") < a + 200)).repartition(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = str(tmp_path / "out")

    def go():
        q = events.dashboard_stream(read("s", s), read("c", c)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def rows(df):
        return sorted(map(tuple, df.select("frame_id", "quality_score", "calibrated_error_m", "is_inlier").collect()), key=repr)

    go()
    whole = rows(events.dashboard_stream(s, c))
    assert len(whole) == 200 and (9, 13.5, None, None) in whole
    assert set(rows(spark.read.parquet(out))) < set(whole)
    # later rows move the watermark beyond all; and one comes too late
    spark.createDataFrame([(10_000, "2024-01-02 00:00:00", 0.0)], "frame_id long, t string, quality_score double").selectExpr("frame_id", "timestamp(t) AS ts", "quality_score").write.mode("append").parquet(str(tmp_path / "s"))
    spark.createDataFrame([(10_001, "2024-01-02 00:00:00", 0.0, True)], "frame_id long, t string, calibrated_error_m double, is_inlier boolean").selectExpr("frame_id", "timestamp(t) AS ts", "calibrated_error_m", "is_inlier").write.mode("append").parquet(str(tmp_path / "c"))
    go()
    assert rows(spark.read.parquet(out)) == whole
    c.where("frame_id = 0").write.mode("append").parquet(str(tmp_path / "c"))
    assert events.late_rows(go()) == 1 and rows(spark.read.parquet(out)) == whole
