"""Packet captures of a 16-laser LiDAR as a Spark data source of points."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "sensor string, packet_ts double, azimuth float, laser_id int, x float, y float, z float"
_ARROW = pa.schema([("sensor", pa.string()), ("packet_ts", pa.float64()), ("azimuth", pa.float32()), ("laser_id", pa.int32()), ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32())])

# The sensor's laser elevations in degrees, the packet's layout and units.
ELEVATIONS = (-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15)
HEADERS, PAYLOAD, BLOCKS, BLOCK, MARK = 42, 1206, 12, 100, 0xEEFF
METRES_PER_UNIT, NEAREST_M = 0.002, 1.0

_RETURN = np.dtype([("distance", "<u2"), ("reflectivity", "u1")])
_BLOCK = np.dtype([("mark", "<u2"), ("azimuth", "<u2"), ("returns", _RETURN, (2, 16))])
_PACKET = np.dtype([("blocks", _BLOCK, (BLOCKS,)), ("tail", "u1", (PAYLOAD - BLOCKS * BLOCK,))])


#: Bytes of a capture that a task reads, and that it reads at a time.
SPLIT, STEP = 64 << 20, 1 << 20
#: Bytes that a record may have whatever the file says.
LONGEST = 262_144
_FORMATS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
_SIZE = HEADERS + PAYLOAD
_MARKS = struct.pack("<H", MARK)


class Capture:
    """An open capture, either byte order, micro- or nanoseconds, whose packets can be read from any byte on.

    A whole packet of the sensor is known by itself wherever it stands: a record head with a plausible time and the sensor's size, and all blocks' marks. Reading goes from record to record, as their sizes say; but a whole
    packet within what another record claims to be, and the next whole packet after what is no record at all, are where it goes on. So it meets every whole packet, from wherever it began.
    """

    def __init__(self, f):
        self.f, self.held, self.begin = f, b"", 0
        head = self.at(0, 24)
        self.empty = len(head) < 24
        if not self.empty:
            if head[:4] not in _FORMATS:
                raise ValueError("no capture that is known: it begins with " + head[:4].hex())
            order, self.parts = _FORMATS[head[:4]]
            self.record = struct.Struct(order + "IIII")
            self.longest = max(LONGEST, struct.unpack_from(order + "I", head, 16)[0] if struct.unpack_from(order + "I", head, 16)[0] < 1 << 24 else 0)
            self.mark = struct.pack(order + "I", _SIZE)

    def at(self, place: int, n: int) -> bytes:
        """n bytes from a place on, fewer where the file ends."""
        k = place - self.begin
        if k < 0 or k + n > len(self.held):
            self.f.seek(place)
            self.held, self.begin, k = self.f.read(max(n, STEP)), place, 0
        return self.held[k : k + n]

    def head(self, place: int) -> tuple[int, int, int] | None:
        """(seconds, parts of a second, size) of the record at a place, none where there can be none."""
        raw = self.at(place, 16)
        if len(raw) < 16:
            return None
        sec, part, size, whole = self.record.unpack(raw)
        return (sec, part, size) if part < self.parts and size <= min(self.longest, whole) else None

    def is_whole(self, place: int) -> bool:
        found = self.head(place)
        if found is None or found[2] != _SIZE:
            return False
        raw = self.at(place, 16 + _SIZE)
        return len(raw) == 16 + _SIZE and all(raw.startswith(_MARKS, 16 + HEADERS + BLOCK * k) for k in range(BLOCKS))

    def next_whole(self, place: int, end: int) -> int | None:
        """Where the first whole packet begins, from a place on and before the end."""
        while place < end:
            raw = self.at(place, min(STEP, end - place + 12))
            k = raw.find(self.mark, 8)
            if k >= 0:
                if place + k - 8 < end and self.is_whole(place + k - 8):
                    return place + k - 8
                place += k - 7
            elif len(raw) < 12:
                return None
            else:
                place += len(raw) - 11
        return None

    def packets(self, begin: int = 0, end: int | None = None) -> Iterator[tuple[float, bytes]]:
        """(seconds, payload) of the sensor's packets from the first whole one at or after begin (the file's first record, for 0) to the first whole one at or after end, which isn't read. A record that the file cuts off is none."""
        if self.empty:
            return
        end = 1 << 62 if end is None else end
        place = 24 if begin <= 24 else self.next_whole(begin, end)
        while place is not None:
            if place >= end and self.is_whole(place):
                return
            found = self.head(place)
            after = place + 1 if found is None else place + 16 + found[2]
            if found is None or not self.is_whole(place):
                if found is None and len(self.at(place, 16)) < 16:
                    return
                inner = self.next_whole(place + 1, after if found is not None else 1 << 62)
                if inner is not None or found is None:
                    place = inner
                    continue
            if found[2] == _SIZE:
                raw = self.at(place + 16 + HEADERS, PAYLOAD)
                if len(raw) < PAYLOAD:
                    return
                yield found[0] + found[1] / self.parts, raw
            place = after


def decoded(payloads: list[bytes], times: list[float], sensor: str) -> pa.RecordBatch:
    """The points of packets: blocks without the mark and returns no farther than NEAREST_M are left out; both firings of a block share its azimuth."""
    p = np.frombuffer(b"".join(payloads), _PACKET)["blocks"]
    metres = p["returns"]["distance"] * METRES_PER_UNIT
    k, b, firing, laser = np.nonzero((metres > NEAREST_M) & (p["mark"] == MARK)[:, :, None, None])
    d, turn, up = metres[k, b, firing, laser], np.radians(p["azimuth"][k, b] / 100.0), np.radians(ELEVATIONS)[laser]
    xyz = d * np.cos(up) * np.sin(turn), d * np.cos(up) * np.cos(turn), d * np.sin(up)
    columns = [pa.array([sensor] * len(k), pa.string()), pa.array(np.array(times)[k]), pa.array((p["azimuth"][k, b] / 100.0).astype(np.float32)), pa.array(laser.astype(np.int32)), *(pa.array(c.astype(np.float32)) for c in xyz)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Part(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        self.path, self.begin, self.end = path, begin, end


class PcapReader(DataSourceReader):
    """A partition for each so many bytes of a file; each packet is read by the one in which it begins, but those that can't be known by themselves by one before. Packets are decoded a few hundred at a time."""

    def __init__(self, options: dict):
        self.path, self.sensor, self.split = options["path"], options.get("sensor", ""), int(options.get("splitbytes", SPLIT))

    def _store(self) -> tuple[fs.FileSystem, str]:
        """Captures are opened by pyarrow, so schemes that only Hadoop knows aren't."""
        uri = self.path
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def partitions(self) -> list[_Part]:
        store, path = self._store()
        at = store.get_file_info(path)
        files = [at] if at.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
        parts = [_Part(i.path, k, k + self.split if k + self.split < i.size else None) for i in files for k in range(0, max(i.size, 1), self.split)]
        return parts or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with self._store()[0].open_input_file(partition.path) as f:
            held, times = [], []
            for t, payload in Capture(f).packets(partition.begin, partition.end):
                held.append(payload)
                times.append(t)
                if len(held) == 256:
                    yield decoded(held, times, self.sensor)
                    held, times = [], []
            if held:
                yield decoded(held, times, self.sensor)


class PcapDataSource(DataSource):
    """format("wayfold_pcap"): a file or folder of captures; option sensor names the sensor, splitBytes says how much of a file is a task's."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader({k.lower(): v for k, v in self.options.items()})


def read_points(spark: SparkSession, path: str, sensor: str = "", split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(PcapDataSource)
    return spark.read.format("wayfold_pcap").option("sensor", sensor).option("splitBytes", split_bytes).load(path)
