"""The tracker as a stateful stream: typed state for each drive, frames in order within each trigger, beginning with what a batch run ended with if there was one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Tracking
from ..operators.track import ROWS, Tracks, followed, seen_in

PROGRESS = "last long, next_id long"
#: A track; lat and lon are value, speed, and their variances and covariance, depth value and variance.
TRACK = "id long, lat array<double>, lon array<double>, depth array<double>, hits long, misses long, age long, scores array<double>"
_TRACK = [c.split()[0] for c in TRACK.split(", ")]
_ROWS = [c.split()[0] for c in ROWS.split(", ")]
#: Frames that are worked off, and whose rows are given out, at a time.
CHUNK = 10_000


class DriveTracker(StatefulProcessor):
    """One drive: how far it has come, and its tracks, of which there are as many as frames have shown lately, however long the drive."""

    def __init__(self, spec: Tracking = Tracking()):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", PROGRESS)
        self.tracks = handle.getListState("tracks", TRACK)

    def _load(self) -> tuple[int, Tracks]:
        if not self.progress.exists():
            return -(1 << 62), Tracks(self.spec)
        last, next_id = self.progress.get()
        held = [{k: list(v) if isinstance(v, (list, tuple)) else v for k, v in zip(_TRACK, row, strict=True)} for row in self.tracks.get()] if self.tracks.exists() else []
        return last, Tracks(self.spec, {"next_id": next_id, "tracks": held})

    def _save(self, last: int, tracks: Tracks) -> None:
        state = tracks.state()
        self.progress.update((last, state["next_id"]))
        if state["tracks"]:
            self.tracks.put([tuple(t[k] for k in _TRACK) for t in state["tracks"]])
        else:
            self.tracks.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, tracks = self._load()
        frames = [(int(f), seen_in(s)) for part in rows for f, s in zip(part["frame_id"], part["seen"], strict=True) if f > last]
        frames.sort(key=lambda x: x[0])
        for k in range(0, len(frames), CHUNK):
            out = followed(tracks, frames[k : k + CHUNK], int(key[0]))
            yield pd.DataFrame(out, columns=_ROWS)
        if frames:
            self._save(frames[-1][0], tracks)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.itertuples():
            self.progress.update((int(row.last), int(row.next_id)))
            if len(row.tracks):
                self.tracks.put([tuple(list(map(float, t[k])) if k in ("lat", "lon", "depth", "scores") else int(t[k]) for k in _TRACK) for t in row.tracks])


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Has the session keep streams' state in RocksDB, as typed state needs. spark.sql.streaming.stateStore.encodingFormat may be set to avro for a session of such streams alone: later versions may then add fields, but joins of streams don't run with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def stabilised_stream(frames: DataFrame, spec: Tracking = Tracking(), initial: DataFrame | None = None) -> DataFrame:
    """A stream of (drive_id, frame_id, seen) as ROWS. initial: (drive_id, last, next_id, tracks) for drives that a batch run has gone through so far, as track.final_states gives it.

    Frames that come after a later one of their drive has been worked off are dropped, as a batch run would have had them earlier. A trigger's frames of a drive are put in order by the task that has the drive; its state is
    the drive's place and its living tracks. Null drives are not allowed.
    """
    with_rocksdb(frames.sparkSession)
    start = initial.groupBy("drive_id") if initial is not None else None
    slim = frames.select("drive_id", "frame_id", F.transform("seen", lambda s: F.struct(s.lat.alias("lat"), s.lon.alias("lon"), s.depth.alias("depth"), s.score.alias("score"))).alias("seen"))
    return slim.groupBy("drive_id").transformWithStateInPandas(DriveTracker(spec), ROWS, "Append", "None", start)
