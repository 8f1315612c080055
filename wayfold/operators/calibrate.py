"""Calibration: mean offsets, errors before and after, and a search over a grid of ray offsets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE, REFERENCE_LAT, Grid
from ..functions.basic import let
from ..functions.geo import cell_key, haversine_m, shifted
from ..functions.polygon import edge_error_m, with_outlines
from ..functions.score import accuracy_label, improvement_pct
from ..shared import cut
from ..sources.sinks import nested
from .localize import raw_targets
from .quantile import SLICES, counted_percentile, percentiles


def records(matches: DataFrame, targets: DataFrame, min_score: float = 0.0, lat_offset: float = 0.0, lon_offset: float = 0.0) -> DataFrame:
    """What calibration starts from: matches of min_score or more whose frame has a target, with raw_lat, raw_lon, and dlat, dlon from there to the building. A missing score counts as 0."""
    t = raw_targets(targets, lat_offset, lon_offset).select("frame_id", "raw_lat", "raw_lon")
    r = matches.where(F.coalesce("score", F.lit(0.0)) >= min_score).join(t, "frame_id")
    return r.withColumns({"dlat": F.col("b_lat") - F.col("raw_lat"), "dlon": F.col("b_lon") - F.col("raw_lon")})


def per_building(records: DataFrame) -> DataFrame:
    """The best-scoring record of each building, the first frame on ties."""
    w = W.partitionBy(cell_key(F.col("b_lat"), F.col("b_lon"))).orderBy(F.desc("score"), "frame_id")
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mean_offsets(records: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of building minus raw target, in degrees, and the means in metres; 0 deviation for one record."""
    dlat, dlon = F.col("b_lat") - F.col("raw_lat"), F.col("b_lon") - F.col("raw_lon")
    g = records.agg(F.count("*").alias("n"), F.avg(dlat).alias("avg_dlat"), F.avg(dlon).alias("avg_dlon"), F.coalesce(F.stddev_samp(dlat), F.lit(0.0)).alias("std_dlat"), F.coalesce(F.stddev_samp(dlon), F.lit(0.0)).alias("std_dlon"))
    return g.withColumns({"lat_m": F.col("avg_dlat") * METRES_PER_DEGREE, "lon_m": F.col("avg_dlon") * METRES_PER_DEGREE * F.cos(F.radians(F.lit(REFERENCE_LAT)))})


def _error(lat: Column, lon: Column) -> Column:
    """To the outline, to the centroid where a record has no geometry; an outline that can't be used counts as 999 m."""
    edge = F.round(edge_error_m(lat, lon, F.col("points")), 2)
    return F.when(F.coalesce(F.col("geometry"), F.lit("")) == "", F.round(haversine_m(lat, lon, F.col("b_lat"), F.col("b_lon")), 2)).otherwise(F.coalesce(edge, F.lit(999.0)))


def evaluated(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """records (raw_lat, raw_lon, …) with the error before and after the one row of offsets, the improvement and a label."""
    r = records.join(F.broadcast(offsets.select("avg_dlat", "avg_dlon")))  # one row
    r = r.withColumns({"corrected_lat": F.col("raw_lat") + F.col("avg_dlat"), "corrected_lon": F.col("raw_lon") + F.col("avg_dlon")}).drop("avg_dlat", "avg_dlon")
    parsed, r = "points" in r.columns, with_outlines(r)
    r = r.withColumns({"raw_error_m": _error(F.col("raw_lat"), F.col("raw_lon")), "corrected_error_m": _error(F.col("corrected_lat"), F.col("corrected_lon"))})
    r = r.withColumns({"improvement_m": F.round(F.col("raw_error_m") - F.col("corrected_error_m"), 2), "accuracy_label": accuracy_label(F.col("corrected_error_m"))})
    return r if parsed else r.drop("points")


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row: frames, buildings, mean errors, the mean of the buildings' means, improvement, and counts by error band."""
    b = results.groupBy(cell_key(F.col("b_lat"), F.col("b_lon")).alias("k")).agg(F.avg("corrected_error_m").alias("m"), F.sum("corrected_error_m").alias("sc"), F.sum("raw_error_m").alias("sr"), F.count("*").alias("n"), *band_counts(F.col("corrected_error_m")))
    g = b.agg(F.sum("n").alias("frames"), F.count("*").alias("buildings"), (F.sum("sr") / F.sum("n")).alias("raw_avg_m"), (F.sum("sc") / F.sum("n")).alias("corrected_avg_m"), F.avg("m").alias("per_building_avg_m"), *(F.sum(x).alias(x) for x in BANDS))
    return g.withColumn("improvement_pct", improvement_pct(F.col("raw_avg_m"), F.col("corrected_avg_m")))


BANDS = ("inside", "under_3", "under_5", "under_10", "under_20", "from_20")


def band_counts(e: Column) -> list[Column]:
    edges = ((e == 0), (e > 0) & (e < 3), (e >= 3) & (e < 5), (e >= 5) & (e < 10), (e >= 10) & (e < 20), e >= 20)
    return [F.count_if(c).alias(n) for c, n in zip(edges, BANDS, strict=True)]


def grid(spark: SparkSession, g: Grid = Grid()) -> DataFrame:
    """(cell, along, cross): the offsets to try, in order; made of whole numbers, so no step drifts."""
    i, j = F.expr(f"id div {g.cross_n}"), F.col("id") % g.cross_n
    return spark.range(g.along_n * g.cross_n).select(F.col("id").alias("cell"), (g.along_start + i * g.along_step).alias("along"), (g.cross_start + j * g.cross_step).alias("cross"))


def _offsets(cell: Column | np.ndarray, g: Grid) -> tuple:
    """along and cross of a cell; made of whole numbers, so no step drifts."""
    j = cell % g.cross_n
    return g.along_start + (cell - j) / g.cross_n * g.along_step, g.cross_start + j * g.cross_step


def offset_error(along: Column, cross: Column) -> Column:
    """From the shifted target to the outline; to the centroid if there are fewer than three vertices. Unrounded."""
    p = shifted(F.col("lat"), F.col("lon"), F.col("heading"), F.col("depth"), along, cross)
    return let(p, lambda t: F.coalesce(edge_error_m(t.lat, t.lon, F.col("points")), haversine_m(t.lat, t.lon, F.col("b_lat"), F.col("b_lon"))))


#: Errors that a batch of a task holds for each edge of its longest outline.
BATCH = 100_000


def _spread(records: DataFrame) -> DataFrame:
    """What grid errors are computed of, dealt to all tasks: a few records are much work."""
    place = ["lat", "lon", "heading", "depth", "b_lat", "b_lon"]
    r = records.select("frame_id", *place, *(c for c in ("geometry", "points") if c in records.columns))
    r = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")
    return with_outlines(r, scrape=False).select("frame_id", *(F.col(c).cast("double").alias(c) for c in place), "points")


def grid_errors(records: DataFrame, g: Grid = Grid()) -> DataFrame:
    """(cell, along, cross, frame_id, err). records, one for each frame: frame_id, lat, lon, heading, depth, b_lat, b_lon, geometry or points (the parsed outline).

    The error of offset_error, for all offsets of a few records at once: a record is dealt to one task, and its errors leave that finished, so nothing but records is exchanged.
    """
    r = _spread(records)
    cells = np.arange(g.along_n * g.cross_n, dtype=np.int32)
    along, cross = _offsets(cells, g)
    most = max(1, BATCH // len(cells))
    names = ["cell", "along", "cross", "frame_id", "err"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, most):
                b = whole.slice(k, most)
                n = b.num_rows
                err = _grid_error(b, along, cross)
                again = [pa.array(np.tile(x, n)) for x in (cells, along, cross)]
                yield pa.RecordBatch.from_arrays([*again, b.column("frame_id").take(pa.array(np.repeat(np.arange(n), len(cells)))), pa.array(err.ravel())], names)

    kind = dict(r.dtypes)["frame_id"]
    return r.mapInArrow(run, f"cell int, along double, cross double, frame_id {kind}, err double")


def _grid_error(b: pa.RecordBatch, along: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """offset_error of each record (a row) at each offset (a column)."""
    known = lambda x, none=np.nan: pc.fill_null(x, none).to_numpy(zero_copy_only=False)
    lat, lon, heading, depth, b_lat, b_lon = (known(b.column(c), -np.inf if c == "depth" else np.nan)[:, None] for c in ("lat", "lon", "heading", "depth", "b_lat", "b_lon"))

    rad = np.radians
    far = lambda a: 2 * EARTH_RADIUS_M * np.arcsin(np.fmin(1.0, np.sqrt(a)))  # noqa: E731  what isn't known is on the other side of the earth, as in haversine_m

    with np.errstate(all="ignore"):
        d = np.maximum(1.0, depth + along)
        h = np.radians(heading + np.degrees(np.arctan2(cross, d)))
        y, x = lat + d * np.cos(h) / METRES_PER_DEGREE, lon + d * np.sin(h) / (METRES_PER_DEGREE * math.cos(math.radians(REFERENCE_LAT)))
        level = np.cos(rad(y))

        def arc(y1: np.ndarray, x1: np.ndarray, level: np.ndarray, y2: np.ndarray, x2: np.ndarray) -> np.ndarray:
            """The square of the sine of half the angle between two places, by which distances are ordered; level: the cosine of y1."""
            return np.sin(rad(y2 - y1) / 2) ** 2 + level * np.cos(rad(y2)) * np.sin(rad(x2 - x1) / 2) ** 2

        points = b.column("points")
        size, at = known(pc.list_value_length(points), 0), points.flatten()
        ends, p_lon, p_lat = np.cumsum(size), known(at.field("lon")), known(at.field("lat"))
        least, odd = np.full(y.shape, np.nan), np.zeros(y.shape, bool)
        none = size < 3
        least[none] = arc(y[none], x[none], level[none], b_lat[none], b_lon[none])
        for i in range(size.max(initial=0)):
            of = np.flatnonzero((size > i) & ~none)
            p = (ends - size)[of] + i
            q = np.where(i > 0, p - 1, ends[of] - 1)
            py, px, qy, qx, ty, tx = *(v[:, None] for v in (p_lat[p], p_lon[p], p_lat[q], p_lon[q])), y[of], x[of]
            dx, dy = px - qx, py - qy
            odd[of] ^= ((py > ty) != (qy > ty)) & (tx < (qx - px) * (ty - py) / (qy - py) + px)
            if i:
                square = dx * dx + dy * dy
                k = np.where(square == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((tx - qx) * dx + (ty - qy) * dy) / square)))
                least[of] = np.fmin(least[of], arc(ty, tx, level[of], qy + k * dy, qx + k * dx))
        return np.where(odd, 0.0, far(least))


def _grid_counts(records: DataFrame, g: Grid, left: DataFrame | None = None, limits: np.ndarray | None = None) -> DataFrame:
    """The slices of cells' errors as counted_percentile wants them, and of each the sum (_sum) and how many are 0 (_zero). records: those of _spread, written; left: the cells and bounds to count in; limits: the greatest error that counts in each cell.

    Errors are computed, and counted, in the task of their records: at the end it gives no more rows than there are slices of cells, however many records it had.
    """
    cells = np.arange(g.along_n * g.cross_n)
    low, high, last = np.zeros(len(cells)), limits, np.zeros(len(cells), bool)
    if left is not None:
        rows = left.select("cell", "_low", "_high", "_last").collect()  # as many rows as the grid has cells
        cells = np.array([r.cell for r in rows])
        low, high, last = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    top = None if limits is None else limits[cells]
    along, cross = _offsets(cells, g)
    most, usual = max(1, BATCH // len(cells)), 4 * g.floor_m
    names = ["cell", "_at", "_n", "_least", "_most", "_sum", "_zero"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, zero, total = (np.zeros(len(cells) * SLICES, t) for t in (np.int64, np.int64, float))
        ends = np.full((2, len(n)), np.inf)  # the greatest with a minus
        for whole in batches:
            for k in range(0, whole.num_rows, most):
                err = _grid_error(whole.slice(k, most), along, cross)
                counts = np.ones(err.shape, bool) if high is None else (err >= low) & (err <= high)
                if top is not None:
                    counts &= err <= top
                of, e = np.broadcast_to(np.arange(len(cells)), err.shape)[counts], err[counts]
                one = last[of]
                if one.any():
                    v, w = e[one], of[one]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells[w], v, np.ones(len(v), np.int64), v, v, v, (v == 0).astype(np.int64))], names)
                    of, e = of[~one], e[~one]
                share = e / (e + usual) if high is None else (e - low[of]) / (high[of] - low[of])
                at = of * SLICES + np.minimum(share * SLICES, SLICES - 1).astype(np.int64)
                np.add.at(n, at, 1)
                np.add.at(zero, at, e == 0)
                np.add.at(total, at, e)
                np.minimum.at(ends[0], at, e)
                np.minimum.at(ends[1], at, -e)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells[at // SLICES], (at % SLICES).astype(float), n[at], ends[0][at], -ends[1][at], total[at], zero[at])], names)

    r = records.mapInArrow(run, "cell long, _at double, _n long, _least double, _most double, _sum double, _zero long")
    sums = (F.sum(c).alias(c) for c in ("_n", "_sum", "_zero"))
    return r.groupBy("cell", "_at").agg(*sums, F.min("_least").alias("_least"), F.max("_most").alias("_most")).withColumn("_rows", F.col("_n"))


def grid_totals(records: DataFrame, g: Grid = Grid()) -> DataFrame:
    """grid_scores of grid_errors of records, without a row for each error: in each round errors are computed again and counted in their tasks, and neither written nor exchanged. Records are computed once."""
    r = cut(_spread(records))
    med = counted_percentile(lambda left: _grid_counts(r, g, left), "cell", 0.5)
    limits = np.full(g.along_n * g.cross_n, -1.0)
    for cell, x in med.select("cell", "x").collect():  # as many rows as the grid has cells
        limits[cell] = max(g.outlier_scale * x, g.floor_m)
    first = cut(_grid_counts(r, g, limits=limits))
    mid = counted_percentile(lambda left: first if left is None else _grid_counts(r, g, left, limits), "cell", 0.5).select("cell", F.col("x").alias("median"))
    of = first.groupBy("cell").agg((F.sum("_sum") / F.sum("_n")).alias("mean"), F.sum("_zero").alias("inside"))
    of = of.withColumns(dict(zip(("along", "cross"), _offsets(F.col("cell"), g), strict=True)))
    return of.join(mid, "cell").select("cell", "along", "cross", "mean", "median", "inside")


def grid_scores(errors: DataFrame, g: Grid = Grid()) -> DataFrame:
    """(cell, along, cross, mean, median, inside) of each cell's inliers: errors up to twice the median, floor_m at least. A cell's errors may be those of a whole table: none is gathered in a task."""
    e = cut(errors.select("cell", "err"))
    med = percentiles(e, "err", {"med": 0.5}, by=("cell",), written=True).select("cell", F.greatest(g.outlier_scale * F.col("med"), F.lit(g.floor_m)).alias("thr"))
    inl = cut(e.join(med, "cell").where(F.col("err") <= F.col("thr")))
    mid = percentiles(inl, "err", {"median": 0.5}, by=("cell",), written=True).select("cell", "median")
    of = inl.groupBy("cell").agg(F.avg("err").alias("mean"), F.count_if(F.col("err") == 0).alias("inside"))
    of = of.withColumns(dict(zip(("along", "cross"), _offsets(F.col("cell"), g), strict=True)))
    return of.join(mid, "cell").select("cell", "along", "cross", "mean", "median", "inside")


def running_best(scores: DataFrame, g: Grid = Grid(), stop_early: bool = True) -> DataFrame:
    """One row: the cell a sequential search would end with, and whether it met the goal. It keeps the first best mean so far and, if it may, stops when that and its median are below goal_m."""
    w = W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)  # as many rows as the grid has cells
    best = F.min(F.struct("mean", "cell", "median", "inside", "along", "cross")).over(w)
    r = scores.withColumn("b", best).withColumn("met", (F.col("b.mean") < g.goal_m) & (F.col("b.median") < g.goal_m))
    at = F.coalesce(F.min(F.when(F.col("met"), F.col("cell"))), F.max("cell")) if stop_early else F.max("cell")
    end = r.agg(at.alias("at"))
    return r.join(F.broadcast(end), F.col("cell") == F.col("at")).select("b.*", F.col("at").alias("stopped_at"), "met")


def inlier_breakdown(records: DataFrame, along: float, cross: float, g: Grid = Grid()) -> DataFrame:
    """(frame_id, calibrated_error_m, is_inlier, is_polygon_hit, threshold_m, group_median_m) at one pair of offsets."""
    e = cut(with_outlines(records, scrape=False).select("frame_id", offset_error(F.lit(along), F.lit(cross)).alias("err")))
    med = percentiles(e, "err", {"med": 0.5}, written=True).select("med")
    thr = F.greatest(g.outlier_scale * F.col("med"), F.lit(g.floor_m))
    return e.join(F.broadcast(med)).select("frame_id", F.round("err", 3).alias("calibrated_error_m"), (F.col("err") <= thr).alias("is_inlier"), (F.col("err") == 0).alias("is_polygon_hit"), F.round(thr, 2).alias("threshold_m"), F.round("med", 3).alias("group_median_m"))


def offset_parts(records: DataFrame, calibrated_on: DataFrame, min_score: float = 0.0, one_per_building: bool = True) -> tuple[DataFrame, DataFrame]:
    """The record of offsets for tables of any size: its head, one row with calibration and summary, and its lines, the records with their errors. calibrated_on: the records whose mean offsets are applied to all. Both are computed once."""
    offsets = cut(mean_offsets(calibrated_on))
    results = cut(evaluated(records, offsets))
    s, o = evaluation_summary(results), offsets
    line = lambda name, c: F.format_string(f"{name} = %.6f", c)
    r2 = lambda c, n, digits=2: F.round(c, digits).alias(n)
    calibration = F.struct(
        F.col("n").alias("n_frames_used"), F.col("buildings").alias("n_buildings_covered"), F.lit(min_score).alias("min_score_gate"), F.lit(one_per_building).alias("per_building_dedup"), "avg_dlat", "avg_dlon", "std_dlat", "std_dlon",
        F.col("lat_m").alias("offset_m_lat"), F.col("lon_m").alias("offset_m_lon"), F.array(line("PROJECTION_LAT_OFFSET", F.col("avg_dlat")), line("PROJECTION_LON_OFFSET", F.col("avg_dlon"))).alias("cfg_lines"),
    )
    summary = F.struct(
        F.col("frames").alias("total_frames"), F.col("buildings").alias("unique_buildings"), r2("raw_avg_m", "raw_avg_error_m"), r2("corrected_avg_m", "corrected_avg_error_m"), r2("per_building_avg_m", "per_building_avg_error_m"),
        r2(F.col("raw_avg_m") - F.col("corrected_avg_m"), "improvement_m"), r2("improvement_pct", "improvement_pct", 1), "inside", F.col("under_3").alias("sub_3m"), F.col("under_5").alias("excellent_lt5m"), F.col("under_10").alias("good_lt10m"),
    )
    head = o.join(F.broadcast(s)).select(calibration.alias("calibration"), summary.alias("summary"))  # one row each
    rows = results.select("frame_id", "b_lat", "b_lon", "score", "raw_lat", "raw_lon", "corrected_lat", "corrected_lon", "raw_error_m", "corrected_error_m", "improvement_m", "accuracy_label")
    return head, rows


def offset_record(records: DataFrame, calibrated_on: DataFrame, min_score: float = 0.0, one_per_building: bool = True, most: int = 100_000) -> DataFrame:
    """offset_parts as one row: calibration, summary and buildings (the lines, by frame), as tools read them from one document."""
    head, rows = offset_parts(records, calibrated_on, min_score, one_per_building)
    return nested(head, most, buildings=rows)


def grid_record(best: DataFrame, records: DataFrame, g: Grid = Grid(), most: int = 100_000) -> DataFrame:
    """One row: the offsets that a search has found (the row of running_best), how they do, and each record's error at them (frames), as tools read them from one document."""
    b = best.first()
    if b is None:
        raise ValueError("a search without records has no best offsets")
    frames = cut(inlier_breakdown(records, b["along"], b["cross"], g))
    r3 = lambda c, n: F.round(c, 3).alias(n)
    head = frames.agg(
        F.lit(round(b["along"], 2)).alias("along_offset_m"), F.lit(round(b["cross"], 2)).alias("cross_offset_m"), r3(F.lit(b["mean"]), "inlier_mean_m"), r3(F.lit(b["median"]), "inlier_median_m"), F.max("threshold_m").alias("inlier_threshold_m"),
        F.max("group_median_m").alias("group_median_m"), F.lit(b["inside"]).alias("sub3m_hits"), F.count("*").alias("total_frames"), F.count_if("is_inlier").alias("inlier_count"), F.lit(b["met"]).alias("target_achieved"),
    )
    return nested(head, most, frames=frames.select("frame_id", "calibrated_error_m", "is_inlier", "is_polygon_hit"))
