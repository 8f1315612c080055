"""Stabilised positions: tracks with a filter per coordinate, detections dealt to them, batch by drive."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, Tracking
from ..functions.geo import map_url
from ..shared import cut, free
from . import scan

# Variances of the start, of each step and of a measurement, for place (degrees), depth (metres) and speed (degrees a frame).
START_VAR = {"place": (4.5e-5) ** 2, "depth": 8.0**2, "speed": (5e-7) ** 2}
STEP_VAR = {"place": (3e-7) ** 2, "depth": 0.1**2, "speed": (1e-8) ** 2}
SEEN_VAR = {"place": (3.5e-5) ** 2, "depth": 6.0**2}

ROWS = "drive_id long, frame_id long, track_id long, stable_lat double, stable_lon double, stable_depth double, track_hits long, track_age long, track_mean_score double, provisional boolean, raw_lat double, raw_lon double, raw_score double, smoothing_delta_m double"


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def moved(axis: list[float]) -> list[float]:
    """One step of a coordinate that has a speed: value, speed, and the variances and covariance of both. Coordinates don't affect each other in the model, so each is filtered alone."""
    x, v, pxx, pxv, pvv = axis
    return [x + v, v, pxx + 2 * pxv + pvv + STEP_VAR["place"], pxv + pvv, pvv + STEP_VAR["speed"]]


def corrected(axis: list[float], z: float, noise: float) -> list[float]:
    x, v, pxx, pxv, pvv = axis
    kx, kv = pxx / (pxx + noise), pxv / (pxx + noise)
    return [x + kx * (z - x), v + kv * (z - x), (1 - kx) * pxx, (1 - kx) * pxv, pvv - kv * pxv]


def _exact(cost: list[list[float]]) -> list[list[int]]:
    """The costs as whole numbers in one unit, so that sums don't depend on their order; what isn't a finite number is dearer than all others together."""
    ratios = [[x.as_integer_ratio() if math.isfinite(x) else None for x in map(float, row)] for row in cost]
    unit = max((q[1] for row in ratios for q in row if q), default=1)
    most = 1 + sum(abs(q[0]) * (unit // q[1]) for row in ratios for q in row if q)
    return [[q[0] * (unit // q[1]) if q else most for q in row] for row in ratios]


def assigned(cost: list[list[float]]) -> dict[int, int]:
    """Row -> column of a matching of as many pairs as the shorter side has, with the least total cost, by shortest augmenting paths: n² m steps for n rows (or columns, if fewer) and m of the others.

    Of equally cheap ones it is that in which the first row has the lowest column, then the second, and so on; a row without a column comes behind all that have one.
    """
    if not cost or not cost[0]:
        return {}
    rows, columns = len(cost), len(cost[0])
    # a pair's cost, and in a far smaller unit how far its row has got towards its first column
    base = columns + 1
    far = base ** (rows + 1)
    grid = [[x * far - (columns - c) * base ** (rows - 1 - r) for c, x in enumerate(row)] for r, row in enumerate(_exact(cost))]
    flip = rows > columns
    if flip:
        grid = [list(c) for c in zip(*grid, strict=True)]
    n, m = len(grid), len(grid[0])
    by_row, by_column, of, before = [0] * n, [0] * (m + 1), [-1] * (m + 1), [m] * m
    for r in range(n):
        # the cheapest way from row r over matched columns to a free one; column m stands for its beginning
        of[m], at, reach, done = r, m, [None] * m, [False] * (m + 1)
        while of[at] >= 0:
            done[at] = True
            row, step, to = of[at], None, m
            for c in range(m):
                if not done[c]:
                    x = grid[row][c] - by_row[row] - by_column[c]
                    if reach[c] is None or x < reach[c]:
                        reach[c], before[c] = x, at
                    if step is None or reach[c] < step:
                        step, to = reach[c], c
            for c in range(m + 1):
                if done[c]:
                    by_row[of[c]] += step
                    by_column[c] -= step
                elif c < m and reach[c] is not None:
                    reach[c] -= step
            at = to
        while at != m:
            of[at], at = of[before[at]], before[at]
    pairs = ((of[c], c) for c in range(m) if of[c] >= 0)
    return dict(sorted((c, r) if flip else (r, c) for r, c in pairs))


class Tracks:
    """The tracks of one drive. State goes in and out as plain lists, so that it can be kept by a streaming job."""

    def __init__(self, spec: Tracking = Tracking(), state: dict | None = None):
        self.spec = spec
        self.next_id = state["next_id"] if state else 1
        self.tracks: list[dict] = [dict(t) for t in state["tracks"]] if state else []

    def state(self) -> dict:
        return {"next_id": self.next_id, "tracks": self.tracks}

    def _start(self, d: tuple[float, float, float, float]) -> None:
        lat, lon, depth, score = d
        axis = lambda x: [x, 0.0, START_VAR["place"], 0.0, START_VAR["speed"]]
        self.tracks.append({"id": self.next_id, "lat": axis(lat), "lon": axis(lon), "depth": [depth, START_VAR["depth"]], "hits": 1, "misses": 0, "age": 0, "scores": [score]})
        self.next_id += 1

    def _see(self, t: dict, d: tuple[float, float, float, float]) -> None:
        lat, lon, depth, score = d
        scale = max(0.4, min(2.5, 100 / max(score, 10.0)))
        t["lat"], t["lon"] = corrected(t["lat"], lat, SEEN_VAR["place"] * scale), corrected(t["lon"], lon, SEEN_VAR["place"] * scale)
        x, p = t["depth"]
        k = p / (p + SEEN_VAR["depth"] * scale)
        t["depth"] = [x + k * (depth - x), (1 - k) * p]
        t["scores"] = [*t["scores"], score][-5:]
        t["hits"] += 1
        t["misses"] = 0

    def _meets(self, seen: list[tuple[float, float, float, float]]) -> bool:
        """Whether any detection is within reach of a track: else no assignment, whatever it is, deals one to any. Two places are as far apart as their latitudes at least."""
        reach = self.spec.reach_m
        band = 1.001 * reach / math.radians(EARTH_RADIUS_M)
        return any(abs(t["lat"][0] - d[0]) <= band and metres(t["lat"][0], t["lon"][0], d[0], d[1]) <= reach for t in self.tracks for d in seen)

    def step(self, seen: list[tuple[float, float, float, float]]) -> list[dict]:
        """A frame goes by: detections (lat, lon, depth, score) are dealt to tracks, others begin tracks, tracks missed too often end. What has enough hits is returned."""
        s = self.spec
        for t in self.tracks:
            t["lat"], t["lon"], t["depth"] = moved(t["lat"]), moved(t["lon"]), [t["depth"][0], t["depth"][1] + STEP_VAR["depth"]]
            t["age"] += 1
            t["misses"] += 1
        taken = set()
        if self._meets(seen):
            cost = [[metres(t["lat"][0], t["lon"][0], d[0], d[1]) for d in seen] for t in self.tracks]
            for r, c in assigned(cost).items():
                if cost[r][c] <= s.reach_m:
                    taken.add(c)
                    if seen[c][3] >= s.min_update:
                        self._see(self.tracks[r], seen[c])
        for c, d in enumerate(seen):
            if c not in taken and d[3] >= s.min_start:
                self._start(d)
        self.tracks = [t for t in self.tracks if t["misses"] <= s.max_misses]
        return [t for t in self.tracks if t["hits"] >= s.min_hits]

    def frame(self, best: tuple[float, float, float, float] | None, others: list[tuple[float, float, float, float]]) -> tuple | None:
        """The report on a frame, without its ids: None where nothing was seen well enough, or no track is near."""
        s = self.spec
        if best is None or best[3] < s.gate:
            self.step([])
            return None
        found = self.step([best, *(d for d in others if d[3] >= s.min_update)])
        lat, lon = best[:2]
        gap = lambda t: metres(t["lat"][0], t["lon"][0], lat, lon)
        provisional = not found
        if provisional:
            found = [min(self.tracks, key=gap)] if self.tracks else []
            if not found or gap(found[0]) > s.cap_m:
                return None
        mean = lambda t: sum(t["scores"]) / len(t["scores"])
        t = max(found, key=lambda t: 10.0 * t["hits"] + mean(t) - 0.1 * gap(t))
        far = gap(t)
        at = (lat, lon, 0.0) if far > s.cap_m else (t["lat"][0], t["lon"][0], round(far, 2))
        return t["id"], at[0], at[1], t["depth"][0], t["hits"], t["age"], mean(t), provisional, lat, lon, best[3], at[2]


def followed(tracks: Tracks, frames: Iterable[tuple[int, list[tuple[float, float, float, float]]]], drive: int) -> list[tuple]:
    """Rows of ROWS for frames in order, each with its candidates, best first."""
    out = []
    for frame, seen in frames:
        row = tracks.frame(seen[0] if seen else None, seen[1:])
        if row is not None:
            out.append((drive, frame, *row))
    return out


def frame_candidates(spine: DataFrame, candidates: DataFrame, most: int = Tracking.candidates) -> DataFrame:
    """(drive_id, frame_id, seen) for every frame of the spine (drive_id, frame_id): its best candidates (rank, b_lat, b_lon, depth, score), all with the frame's depth; frames without any age the tracks."""
    c = candidates.where(F.col("rank") <= most).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon"), "depth", "score"))).alias("seen"))
    return spine.select("drive_id", "frame_id").join(c, "frame_id", "left")


def _seen_of(frames: pa.ListArray) -> Iterator[list[tuple[float, float, float, float]]]:
    """seen_in of each frame of a column; values without nulls are taken as numbers at once."""
    values = lambda a: a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()
    at = frames.flatten()
    rows = list(zip(*(values(at.field(c)) for c in ("lat", "lon", "depth", "score")), strict=True))
    begin = 0
    for n in frames.value_lengths().to_pylist():
        yield rows[begin : begin + (n or 0)]
        begin += n or 0


def seen_in(frame: object) -> list[tuple[float, float, float, float]]:
    return [(d["lat"], d["lon"], d["depth"], d["score"]) for d in frame] if frame is not None else []


class _Life:
    """Tracks that are known by where they began (frame, and the how manieth of it): so two runs over the same frames agree on them, whatever either has seen before."""

    def __init__(self, spec: Tracking, state: list | None = None):
        state = state or []
        self.born = {k + 1: tuple(t["born"]) for k, t in enumerate(state)}
        self.tracks = Tracks(spec, {"next_id": len(state) + 1, "tracks": [{**t, "id": k + 1} for k, t in enumerate(state)]})

    def state(self) -> str:
        return json.dumps([{**{k: v for k, v in t.items() if k != "id"}, "born": self.born[t["id"]]} for t in self.tracks.tracks])

    def frame(self, frame: int, seen: list[tuple[float, float, float, float]]) -> tuple[tuple | None, int]:
        """The frame's report, with where its track began in place of its id, and how many tracks have begun."""
        before = self.tracks.next_id
        row = self.tracks.frame(seen[0] if seen else None, seen[1:])
        fresh = self.tracks.next_id - before
        self.born.update((before + k, (frame, k)) for k in range(fresh))
        if len(self.born) > 1000:
            kept = {t["id"] for t in self.tracks.tracks}
            self.born = {k: v for k, v in self.born.items() if k in kept}
        return (None if row is None else (*self.born[row[0]], *row[1:])), fresh


_REPORT = "born_frame long, born_k long, stable_lat double, stable_lon double, stable_depth double, track_hits long, track_age long, track_mean_score double, provisional boolean, raw_lat double, raw_lon double, raw_score double, smoothing_delta_m double"
_RUN = f"drive_id long, _piece int, frame_id long, {_REPORT}, _fresh long, _start string, _end string"


def _run(frames: DataFrame, spec: Tracking) -> DataFrame:
    """_RUN: a row for each frame of a piece that has a report or new tracks, and one without a frame for each piece, with the states that it began and ended with. frames: drive_id, _piece, frame_id, seen, _warm, _given."""
    arrow = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in (c.split() for c in _RUN.split(", "))])
    nothing = (None,) * len(_REPORT.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, life, start = None, None, None
        end = lambda: [(*at, None, *nothing, 0, life.state() if start is None else start, life.state())] if at else []
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)
        for b in batches:
            out: list[tuple] = []
            for drive, piece, frame, warm, given, seen in zip(*(b.column(c).to_pylist() for c in ("drive_id", "_piece", "frame_id", "_warm", "_given")), _seen_of(b.column("seen")), strict=True):
                if (drive, piece) != at:
                    out += end()
                    at, life, start = (drive, piece), _Life(spec, json.loads(given) if given else None), None
                if not warm and start is None:
                    start = life.state()
                row, fresh = life.frame(frame, seen)
                if not warm and (row is not None or fresh):
                    out.append((drive, piece, frame, *(row or nothing), fresh, None, None))
            yield packed(out)
        if at:
            yield packed(end())

    return frames.repartition("drive_id", "_piece").sortWithinPartitions("drive_id", "_piece", "frame_id").mapInArrow(run, _RUN)


def pieces_run(frames: DataFrame, spec: Tracking, warm_up: int, ranges: int | None) -> tuple[DataFrame, int]:
    """_run's rows for all pieces of all drives, and the number of rounds: each piece as if its drive had been gone through from the beginning.

    In the first round a piece begins without tracks, warm_up frames before its own. Where the state it so came to isn't that with which the piece before it ended, it is run again from that one, in rounds, until all
    seams agree. Tracks that began within the warm-up agree to the last bit, so few pieces run again, unless a track lives on through all of it; a drive of such tracks takes a round for each of its pieces.
    """
    p = scan.pieces(cut(frames.select("drive_id", "frame_id", "seen")), "drive_id", ("frame_id",), ranges)
    t = scan.totals(p, "drive_id")
    a = scan.along("drive_id")
    t = cut(t.withColumns({"_next": F.lead(scan.PIECE).over(a), "_before": F.lag(scan.PIECE).over(a)}))
    r = scan.carried(p, t, "drive_id", "_n", "_next")
    warm = r.where(F.col("_next").isNotNull() & (F.col(scan.PLACE) > F.col("_n") - warm_up)).withColumn(scan.PIECE, F.col("_next"))
    none = F.lit(None).cast("string")
    columns = ["drive_id", scan.PIECE, "frame_id", "seen"]
    done = cut(_run(r.select(*columns, F.lit(False).alias("_warm"), none.alias("_given")).unionByName(warm.select(*columns, F.lit(True).alias("_warm"), none.alias("_given"))), spec))
    rounds = 1
    while True:
        seams = done.where("frame_id IS NULL").select(F.col("drive_id").alias("_d"), F.col(scan.PIECE).alias("_p"), "_start", "_end")
        here = t.select(F.col("drive_id"), scan.PIECE, "_before")
        own = here.join(seams.select("_d", "_p", "_start"), here["drive_id"].eqNullSafe(F.col("_d")) & (here[scan.PIECE] == F.col("_p"))).drop("_d", "_p")
        ends = seams.select("_d", "_p", F.col("_end").alias("_given"))
        wrong = cut(own.join(ends, own["drive_id"].eqNullSafe(F.col("_d")) & (F.col("_before") == F.col("_p"))).where(F.col("_start") != F.col("_given")).select(F.col("drive_id").alias("_d"), F.col(scan.PIECE).alias("_p"), "_given"))
        if not wrong.limit(1).count():
            return done, rounds
        rounds += 1
        again = p.join(wrong, p["drive_id"].eqNullSafe(F.col("_d")) & (p[scan.PIECE] == F.col("_p")))
        new = _run(again.select(*columns, F.lit(False).alias("_warm"), "_given"), spec)
        keep = done.join(wrong.select("_d", "_p"), done["drive_id"].eqNullSafe(F.col("_d")) & (done[scan.PIECE] == F.col("_p")), "left_anti")
        before, done = done, cut(keep.unionByName(new))
        free(before, wrong)


def _numbered(done: DataFrame) -> DataFrame:
    """(_d, _f, _id): the number of the first track that began at each frame of a drive where any did, from 1 on, by the pieces' totals."""
    born = done.where("_fresh > 0").select("drive_id", scan.PIECE, "frame_id", "_fresh")
    inside = F.sum("_fresh").over(W.partitionBy("drive_id", scan.PIECE).orderBy("frame_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("_fresh")
    sums = born.groupBy("drive_id", scan.PIECE).agg(F.sum("_fresh").alias("_s"))
    sums = sums.withColumn("_earlier", F.sum("_s").over(scan.along("drive_id")) - F.col("_s"))
    return scan.carried(born.withColumn("_k", inside), sums, "drive_id", "_earlier").select(F.col("drive_id").alias("_d"), F.col("frame_id").alias("_f"), (F.col("_earlier") + F.col("_k") + 1).alias("_id"))


_STATE = "array<struct<lat:array<double>,lon:array<double>,depth:array<double>,hits:long,misses:long,age:long,scores:array<double>,born:array<long>>>"


def final_states(frames: DataFrame, spec: Tracking = Tracking(), warm_up: int = 200, ranges: int | None = None) -> DataFrame:
    """(drive_id, last, next_id, tracks): how far each drive has come, the number that its next track would get, and its living tracks, from which a stream can go on (streaming.tracker)."""
    frames = cut(frames.select("drive_id", "frame_id", "seen"))
    done, _ = pieces_run(frames, spec, warm_up, ranges)
    begun = done.groupBy("drive_id").agg((F.coalesce(F.sum("_fresh"), F.lit(0)) + 1).alias("next_id"), F.max_by("_end", F.when(F.col("frame_id").isNull(), F.col(scan.PIECE))).alias("_end"))
    ends = frames.groupBy("drive_id").agg(F.max("frame_id").alias("last")).withColumnRenamed("drive_id", "_drive")
    b = begun.join(ends, begun["drive_id"].eqNullSafe(F.col("_drive"))).drop("_drive")
    each = b.select("drive_id", "last", "next_id", F.posexplode_outer(F.from_json("_end", _STATE)).alias("_n", "_t"))
    n = _numbered(done)
    each = each.join(n, each["drive_id"].eqNullSafe(F.col("_d")) & (F.col("_t.born")[0] == F.col("_f")), "left")
    t = F.struct((F.col("_id") + F.col("_t.born")[1]).alias("id"), *(F.col(f"_t.{c}").alias(c) for c in ("lat", "lon", "depth", "hits", "misses", "age", "scores")))
    g = each.groupBy("drive_id", "last", "next_id").agg(F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_n", t.alias("t"))))).alias("_ts"))
    return g.select("drive_id", "last", "next_id", F.col("_ts.t").alias("tracks"))


def stabilised(frames: DataFrame, spec: Tracking = Tracking(), warm_up: int = 200, ranges: int | None = None) -> DataFrame:
    """ROWS with a map address for frame_candidates' rows. A track's life is counted in a drive's frames, in order.

    A drive is gone through in pieces by many tasks, with or without pauses in it (pieces_run); tracks are numbered by their beginnings, over the pieces' totals. Frames are computed once, to the shared folder.
    Frames of a null drive are a drive; a drive has a frame once. An empty table gives no rows.
    """
    done, _ = pieces_run(frames, spec, warm_up, ranges)
    born = _numbered(done)
    rows = done.where("born_frame IS NOT NULL")
    out = rows.join(born, rows["drive_id"].eqNullSafe(F.col("_d")) & (F.col("born_frame") == F.col("_f"))).withColumn("track_id", F.col("_id") + F.col("born_k"))
    out = out.select(*(c.split()[0] for c in ROWS.split(", ")))
    return out.withColumn("gmaps", map_url(F.col("stable_lat"), F.col("stable_lon")))
