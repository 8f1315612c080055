import io
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.operators import lidar
from wayfold.sources import pcap


def payload(rng, bad=0):
    """A packet's payload; so many of its blocks have no mark."""
    out = b""
    for k in range(12):
        out += struct.pack("<HH", 1 if k < bad else 0xEEFF, rng.randrange(36000)) + b"".join(struct.pack("<HB", rng.randrange(400, 3000), 7) for _ in range(32))
    return out + bytes(6)


def record(order, sec, part, body, whole=None):
    return struct.pack(order + "IIII", sec, part, len(body), whole or len(body)) + body


def capture(rng, order="<", nano=False, n=40, garbage=True):
    """A capture's bytes, and the (seconds, payload) that are to be found: of whole packets, and of damaged ones that follow a record."""
    data = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    found, lost = [], False
    for k in range(n):
        kind = rng.choice(["whole", "whole", "whole", "other", "damaged", *(["garbage", "nested", "cut"] if garbage else [])])
        part = rng.randrange(10**9 if nano else 10**6)
        body = bytes(rng.randrange(256) for _ in range(42)) + payload(rng, rng.choice([1, 5, 12]) if kind == "damaged" else 0)
        t = 1000 + k + part / (10**9 if nano else 10**6)
        if kind in ("whole", "damaged"):
            data += record(order, 1000 + k, part, body)
            if kind == "whole" or not lost:
                found.append((t, body[42:]))
            lost = lost and kind != "whole"
        elif kind == "other":
            data += record(order, 1000 + k, part, bytes(rng.randrange(256) for _ in range(rng.randrange(90))))
        elif kind == "garbage":
            data += b"\xff" * 16 + bytes(rng.randrange(256) for _ in range(rng.randrange(300)))
            lost = True
        elif kind == "nested":  # a whole packet within what a record claims to be its own
            data += record(order, 1000 + k, 5, bytes(30) + record(order, 1000 + k, part, body))[: 16 + 30 + 16 + len(body)]
            found.append((t, body[42:]))
            lost = False
        else:  # a record that is shorter than it says
            data += record(order, 1000 + k, part, body)[: rng.randrange(17, 600)]
            lost = True
    return data, found


def packets(data, split):
    out = []
    for a in range(0, len(data), split):
        out += pcap.Capture(io.BytesIO(data)).packets(a, a + split if a + split < len(data) else None)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_split_gives_the_same_packets(seed, monkeypatch):
    rng = random.Random(seed)
    data, found = capture(rng, "<>"[seed % 2], seed % 3 == 0)
    whole = packets(data, 1 << 30)
    for step in (1 << 20, 700):
        monkeypatch.setattr(pcap, "STEP", step)
        for split in (100, 1000, 1264, 5000, len(data) - 1):
            assert packets(data, split) == whole
    marked = [p for p in whole if all(p[1][100 * k : 100 * k + 2] == b"\xff\xee" for k in range(12))]
    assert marked == [p for p in found if all(p[1][100 * k : 100 * k + 2] == b"\xff\xee" for k in range(12))]


def test_a_sound_capture_is_read_record_by_record():
    rng = random.Random(9)
    data, found = capture(rng, garbage=False, n=80)
    assert packets(data, 1 << 30) == found and packets(data, 333) == found
    assert packets(data + record("<", 1, 1, bytes(1248))[:500], 2000) == found  # the last record is cut off
    for short in (b"", data[:23], data[:24], data[:40]):
        assert packets(short, 10) == []
    with pytest.raises(ValueError):
        packets(b"x" * 30, 100)


def test_points_of_splits(spark, tmp_path):
    data, _ = capture(random.Random(1), n=60)
    (tmp_path / "a.pcap").write_bytes(data)
    one, many = pcap.read_points(spark, str(tmp_path), "L1"), pcap.read_points(spark, str(tmp_path), "L1", split_bytes=3000)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == -(-len(data) // 3000)
    count = lambda df: sorted(map(tuple, df.collect()))
    assert len(count(one)) > 5000 and count(one) == count(many)


def test_points_of_a_frames_time(spark):
    rng = random.Random(2)
    p = [(k, rng.choice([rng.uniform(-5, 5), round(rng.uniform(-5, 5), 1)])) for k in range(400)] + [(999, None)]
    f = [(k, round(rng.uniform(-5, 5), 1)) for k in range(60)] + [(99, None), (98, 400.0)]
    for window in (0.1, 0.5, 3.0):
        got = lidar.in_time(spark.createDataFrame(p, "n long, packet_ts double"), spark.createDataFrame(f, "frame_id long, t double"), window)
        assert sorted((r.frame_id, r.n) for r in got.select("frame_id", "n").collect()) == sorted((i, n) for i, t in f for n, x in p if x is not None and t is not None and abs(x - t) <= window / 2)
    assert lidar.in_time(spark.createDataFrame(p, "n long, packet_ts double"), spark.createDataFrame(f, "frame_id long, t double").where(F.lit(False)), 1.0).count() == 0 and math.isfinite(1)
