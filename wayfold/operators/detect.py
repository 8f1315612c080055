"""Detection: pluggable models, the cascade of passes, the best box, masks as runs of pixels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Camera

BOXES = "frame_id long, pass int, x1 double, y1 double, x2 double, y2 double, conf double"
RUNS = "frame_id long, row int, u_start int, u_end int"


# The open-vocabulary class lists and confidences of the passes.
PRIMARY = ("building", "house", "commercial building", "brick wall", "facade", "multi-storey building", "concrete building", "flat roof building")
FALLBACK = ("building", "house", "wall", "structure", "apartment", "office building", "storefront", "architecture", "concrete structure", "terrace building", "construction")


@dataclass(frozen=True)
class Pass:
    """Classes and confidence of one try, and the part of the image (left, top, right, bottom as shares) it looks at."""

    classes: tuple[str, ...]
    conf: float
    crop: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)


PASSES = (Pass(PRIMARY, 0.25), Pass(FALLBACK, 0.10), Pass(FALLBACK, 0.07, (0.4, 0.0, 1.0, 1.0)), Pass(FALLBACK, 0.06, (0.25, 0.0, 0.75, 1.0)))

#: What a user plugs in: image bytes, classes, confidence, crop in pixels or None -> rows (x1, y1, x2, y2, conf) in the crop's pixels.
Detector = Callable[[bytes, tuple[str, ...], float, tuple[int, int, int, int] | None], list[tuple[float, float, float, float, float]]]
#: Image bytes and a box -> a mask of the image's height and width, or None.
Segmenter = Callable[[bytes, tuple[float, float, float, float]], np.ndarray | None]


_MODELS: dict[str, Callable] = {}


def once(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of this key, which a Python worker loads for its first task and keeps; a few of the latest are kept."""
    if key not in _MODELS:
        while len(_MODELS) >= 2:
            del _MODELS[next(iter(_MODELS))]
        _MODELS[key] = load()
    return _MODELS[key]


def small_batches(spark: SparkSession, most_bytes: int) -> None:
    """Batches that Python workers get have so many bytes at most, but for a larger single row: ten thousand pictures are not one batch. A setting of the session, lowered and never raised."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= most_bytes:
        spark.conf.set(name, str(most_bytes))


def detections(
    images: DataFrame, load: Callable[[], Detector], passes: tuple[Pass, ...] = PASSES, camera: Camera = Camera(), key: str | None = None, batch_bytes: int = 64 << 20, profile: ResourceProfile | None = None
) -> DataFrame:
    """BOXES of images (frame_id, content). load makes the model, once for each Python worker; a key names it where another job is to find it there. Later passes run only on images where earlier ones have left no usable box.
    profile: what a task needs (a GPU, say), for clusters that give it."""
    w, h = camera.width, camera.height
    name = key or uuid.uuid4().hex
    small_batches(images.sparkSession, batch_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for b in batches:
            rows = []
            for frame, content in zip(b["frame_id"], b["content"], strict=True):
                for k, p in enumerate(passes, 1):
                    whole = p.crop == (0.0, 0.0, 1.0, 1.0)
                    crop = None if whole else (int(w * p.crop[0]), int(h * p.crop[1]), int(w * p.crop[2]), int(h * p.crop[3]))
                    dx, dy = (0, 0) if whole else crop[:2]
                    got = [(frame, k, x1 + dx, y1 + dy, x2 + dx, y2 + dy, c) for x1, y1, x2, y2, c in model(content, p.classes, p.conf, crop)]
                    rows += got
                    if any(_usable(r[2:6], w, h) for r in got):
                        break
            yield pd.DataFrame(rows, columns=["frame_id", "pass", "x1", "y1", "x2", "y2", "conf"])

    return images.select("frame_id", "content").mapInPandas(run, BOXES, profile=profile)


def _usable(box: tuple[float, float, float, float], w: int, h: int) -> bool:
    x1, y1, x2, y2 = box
    small, high = (x2 - x1) * (y2 - y1) / (w * h) < 0.003, y2 < h * 0.2
    return not (small or high or (x1 + x2) / 2 < w * 0.35 and (y1 + y2) / 2 > h * 0.5)


def best_boxes(boxes: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """One box for each frame that has a usable one: of its first pass with such, the one with most of confidence, area and place. Ties: the first by coordinates."""
    w, h = camera.width, camera.height
    b = boxes.withColumns({"_cx": (F.col("x1") + F.col("x2")) / 2, "_cy": (F.col("y1") + F.col("y2")) / 2, "area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (w * h)})
    b = b.where((F.col("area") >= 0.003) & (F.col("y2") >= h * 0.2) & ~((F.col("_cx") < w * 0.35) & (F.col("_cy") > h * 0.5)))
    b = b.withColumn("box_score", F.col("conf") + 2 * F.col("area") + F.when(F.col("_cx") > w * 0.5, 0.15).otherwise(0.0))
    first = W.partitionBy("frame_id").orderBy("pass", F.desc("box_score"), "x1", "y1", "x2", "y2")
    return b.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_cx", "_cy")


def _moved(mask: np.ndarray, dv: int, du: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(dv, 0) : h + min(dv, 0), max(du, 0) : w + min(du, 0)] = mask[max(-dv, 0) : h + min(-dv, 0), max(-du, 0) : w + min(-du, 0)]
    return out


def _ellipse(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(v, u) for v in range(-r, r + 1) for u in range(-round(r * (1 - (v / r) ** 2) ** 0.5), round(r * (1 - (v / r) ** 2) ** 0.5) + 1)]


def cleaned(mask: np.ndarray, top: int, size: int = 9) -> np.ndarray:
    """A boolean mask without what lies above row `top` or in the top 15 %, closed and then opened by an ellipse. Beyond the border there is nothing to close or open with."""
    m = mask > 0.5
    m[: max(top, int(m.shape[0] * 0.15))] = False
    ring = _ellipse(size)
    grow = lambda x: np.logical_or.reduce([_moved(x, *d) for d in ring])
    shrink = lambda x: ~np.logical_or.reduce([_moved(~x, *d) for d in ring])
    return grow(shrink(shrink(grow(m))))


def mask_runs(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, u_start, u_end) of each run of set pixels."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (r0, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return list(zip(r0.tolist(), a.tolist(), b.tolist(), strict=True))


def masks(boxed: DataFrame, load: Callable[[], Segmenter], camera: Camera = Camera(), key: str | None = None, batch_bytes: int = 64 << 20, profile: ResourceProfile | None = None) -> DataFrame:
    """RUNS of the masks of boxed images (frame_id, content, x1, y1, x2, y2); where the model gives none, the box is filled. The model is loaded once for each Python worker, as for detections."""
    h, w = camera.height, camera.width
    name = key or uuid.uuid4().hex
    small_batches(boxed.sparkSession, batch_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for b in batches:
            rows = []
            for r in b.itertuples():
                mask = model(r.content, (r.x1, r.y1, r.x2, r.y2))
                if mask is None:
                    runs = [(v, int(r.x1), int(r.x2)) for v in range(max(0, int(r.y1)), min(h, int(r.y2))) if int(r.x2) > int(r.x1)]
                else:
                    at = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
                    runs = mask_runs(cleaned(mask[np.ix_(*at)], int(r.y1)))
                rows += [(r.frame_id, *x) for x in runs]
            yield pd.DataFrame(rows, columns=["frame_id", "row", "u_start", "u_end"])

    return boxed.select("frame_id", "content", "x1", "y1", "x2", "y2").mapInPandas(run, RUNS, profile=profile)
