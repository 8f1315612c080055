"""Selection: sightings of one building brought together, the best of each chosen and explained."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE
from ..functions.geo import haversine_m, map_url
from ..functions.polygon import edge_error_m, polygon_points, vertex_mean, with_outlines
from ..functions.score import quality, rationale
from ..shared import cut
from .track import metres


#: The side of a tile in radii, and how far around it a tile's task sees.
TILE, HALO = 64, 8
#: What a place is known to be: nothing yet, the first of a cluster, or within the radius of an earlier first.
OPEN, LEADER, COVERED = 0, 1, 2


class _Near:
    """Places of a tile by cells as wide as the radius."""

    def __init__(self, radius_m: float, lat_deg: float):
        self.radius = radius_m
        self.high = 1.01 * radius_m / math.radians(EARTH_RADIUS_M)
        self.wide = self.high / max(1e-3, math.cos(math.radians(min(89.9, lat_deg))))
        self.cells: dict[tuple[int, int], list[tuple[float, float, int]]] = {}

    def add(self, lat: float, lon: float, n: int = 0) -> None:
        self.cells.setdefault((math.floor(lat / self.high), math.floor(lon / self.wide)), []).append((lat, lon, n))

    def first(self, lat: float, lon: float) -> int:
        """The smallest number of a place within the radius; -1: none."""
        y, x, found = math.floor(lat / self.high), math.floor(lon / self.wide), -1
        for key in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            for a, b, n in self.cells.get(key, ()):
                if (found < 0 or n < found) and metres(lat, lon, a, b) <= self.radius:
                    found = n
        return found


def _tiles(places: DataFrame, keys: list[str], lat: str, lon: str, radius_m: float, halo: float) -> DataFrame:
    """places with _tile and _top (the tile's largest latitude) for each tile that sees them: _own, the one they are in; _whole, those that see all within the radius of them."""
    step, r = TILE * radius_m / METRES_PER_DEGREE, 1.01 * radius_m / math.radians(EARTH_RADIUS_M)
    band = lambda y: F.floor(y / step)
    wide = lambda b: F.lit(step) / F.cos(F.radians(F.least(F.greatest(F.abs(b), F.abs(b + 1)) * step, F.lit(89.0))))
    y, x, more = F.col(lat), F.col(lon), r * F.lit(1) / F.cos(F.radians(F.least(F.abs(F.col(lat)) + halo * r, F.lit(89.0))))
    p = places.withColumn("_band", F.explode(F.sequence(band(y - halo * r), band(y + halo * r)))).withColumn("_w", wide(F.col("_band")))
    p = p.withColumn("_col", F.explode(F.sequence(F.floor((x - halo * more) / F.col("_w")), F.floor((x + halo * more) / F.col("_w")))))
    own = (F.col("_band") == band(y)) & (F.col("_col") == F.floor(x / F.col("_w")))
    inner = halo - 1.1
    whole = F.col("_band").between(band(y - inner * r), band(y + inner * r)) & F.col("_col").between(F.floor((x - inner * more) / F.col("_w")), F.floor((x + inner * more) / F.col("_w")))
    tile = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.col("_band").cast("string"), F.col("_col").cast("string"))
    top = F.greatest(F.abs(F.col("_band")), F.abs(F.col("_band") + 1)) * step + halo * r
    return p.withColumns({"_tile": tile, "_top": top.cast("double"), "_own": own, "_whole": (own | whole) if halo > 2 else own}).drop("_band", "_col", "_w")


def _streamed(rows: DataFrame, order: list[str], lat: str, lon: str, radius_m: float, out: DataFrame, step: Callable) -> DataFrame:
    """Goes through each tile's rows in order. step(firsts, others, lat, lon, row number in the tile, row) gives a row's status, or None where it isn't handed on."""
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, firsts, others = None, None, None
        for b in batches:
            at = {c: b.column(c).to_pylist() for c in (*(c for c in ("_tile", "_top", "_own", "_whole", "status") if c in b.schema.names), lat, lon)}
            kept, status = [], []
            for i in range(b.num_rows):
                if at["_tile"][i] != tile:
                    tile, firsts, others = at["_tile"][i], _Near(radius_m, at["_top"][i]), _Near(radius_m, at["_top"][i])
                    seen: list = []
                got = step(firsts, others, at, i, seen, b)
                if got is not None:
                    kept.append(i)
                    status.append(got)
            if kept:
                part = b.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([pa.array(status, part.schema.field(c).type) if c == names[-1] else part.column(c) for c in names], names)

    return rows.repartition("_tile").sortWithinPartitions("_tile", *order).mapInArrow(run, out.schema)


def leader_clusters(records: DataFrame, radius_m: float = 18.0, lat: str = "b_lat", lon: str = "b_lon", order: str = "frame_id", within: str | None = None) -> DataFrame:
    """records with cluster: the smallest `order` of the cluster's places. In order, a record joins the first cluster whose first record is within the radius, or begins one; within: a column whose values are clustered each by itself. Rows without a place have no cluster.

    records are computed once, to the shared folder. A place that was seen before always joins the same cluster, so only distinct places count, by their first record. Tasks go through
    the places of tiles, and of a margin around them, in order, holding the firsts and what is open. A place near an earlier open one of
    the margin, whose own tile may see more, stays open until the next round, which starts from what is known. So there are as many rounds as
    the order goes back and forth between tiles in steps of less than the radius; each decides the earliest open place at least, and the result is that
    of one pass.
    """
    keys = [within] if within else []
    records = cut(records)
    places = records.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*keys, lat, lon).agg(F.min(order).alias("_first"))
    places = cut(places)

    def decide(firsts: _Near, others: _Near, at: dict, i: int, seen: list, b: pa.RecordBatch) -> int | None:
        y, x, own = at[lat][i], at[lon][i], at["_own"][i]
        if at["status"][i] == LEADER or at["_whole"][i] and firsts.first(y, x) < 0 and others.first(y, x) < 0:
            firsts.add(y, x)
            return LEADER if own else None
        if firsts.first(y, x) >= 0:
            return COVERED if own else None
        others.add(y, x)
        return OPEN if own else None

    state = places.withColumn("status", F.lit(OPEN))
    while True:
        state = cut(_streamed(_tiles(state, keys, lat, lon, radius_m, HALO), ["_first", lat, lon], lat, lon, radius_m, state, decide))
        if state.where(F.col("status") == OPEN).isEmpty():
            break
        state = state.where(F.col("status") < COVERED)

    def join(firsts: _Near, others: _Near, at: dict, i: int, seen: list, b: pa.RecordBatch) -> object:
        y, x = at[lat][i], at[lon][i]
        if at["status"][i] == LEADER:
            firsts.add(y, x, len(seen))
            seen.append(b.column("_first")[i].as_py())
            return None
        n = firsts.first(y, x)
        return seen[n] if n >= 0 else None

    around = _tiles(state.where(F.col("status") == LEADER), keys, lat, lon, radius_m, 1.1)
    inside = _tiles(places.withColumn("status", F.lit(COVERED)), keys, lat, lon, radius_m, 1.1).where("_own")
    clusters = places.select(*(F.col(k).alias("_within") for k in keys), F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), F.col("_first").alias("cluster"))
    rows = around.unionByName(inside).select("*", *(F.col(k).alias("_within") for k in keys), F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), F.col("_first").alias("cluster"))
    found = _streamed(rows, ["status", "_first", lat, lon], lat, lon, radius_m, clusters, join)
    on = (F.col(lat) == F.col("_plat")) & (F.col(lon) == F.col("_plon"))
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_within"))
    return records.join(found, on, "left").drop("_plat", "_plon", *(["_within"] if within else []))


def clustered_quality(clustered: DataFrame) -> DataFrame:
    """Sightings with cluster_size, their quality to 2 places, and their rank in the cluster: best quality, then first frame."""
    n = clustered.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    q = clustered.join(n, "cluster").withColumn("quality_score", F.round(quality(F.col("score"), F.col("angle_off_deg"), F.col("dist_m"), F.col("confidence"), F.col("n_candidates"), F.col("cluster_size")), 2))
    return q.withColumn("cluster_rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("quality_score"), "frame_id")))


def filled(matches: DataFrame) -> DataFrame:
    """Matches read from elsewhere, with the values that stand for missing ones."""
    zero = [c for c in ("confidence", "score_angle", "score_prox", "score_width", "score_depth") if c in matches.columns]
    return matches.withColumns({"angle_off_deg": F.coalesce("angle_off_deg", F.lit(99.0)), "dist_m": F.coalesce("dist_m", F.lit(999.0)), **{c: F.coalesce(c, F.lit(0.0)) for c in zero}})


def smoothed_places(clustered: DataFrame) -> DataFrame:
    """(cluster, lat, lon, method): the vertex mean of the first sighting's outline, or the score-weighted mean of all places where that has none."""
    w = F.greatest(F.col("score"), F.lit(1.0))
    g = clustered.groupBy("cluster").agg(F.min_by(F.coalesce("geometry", F.lit("")), "frame_id").alias("_g"), (F.sum(F.col("b_lat") * w) / F.sum(w)).alias("_lat"), (F.sum(F.col("b_lon") * w) / F.sum(w)).alias("_lon"))
    g = g.withColumn("_c", vertex_mean(polygon_points(F.col("_g"))))
    return g.select("cluster", F.coalesce("_c.lat", "_lat").alias("smooth_lat"), F.coalesce("_c.lon", "_lon").alias("smooth_lon"), F.when(F.col("_c").isNull(), "weighted_mean").otherwise("polygon_centroid").alias("smoothing_method"))


def target_error(lat: str, lon: str) -> Column:
    """From a target to the outline (points), or to the centroid where there is no usable outline; null without a target."""
    edge = edge_error_m(F.col(lat), F.col(lon), F.col("points"))
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.round(F.coalesce(edge, haversine_m(F.col(lat), F.col(lon), F.col("b_lat"), F.col("b_lon"))), 2))


def select_best(clustered: DataFrame, targets: DataFrame | None = None, min_quality: float = 30.0, top_n: int | None = None) -> DataFrame:
    """The best sighting of each cluster of at least min_quality, with its smoothed place, the error of its target, why it was selected, and a map address; best first, top_n of them if given.

    targets (frame_id, ego_lat, ego_lon, target_lat, target_lon, heading_deg) are joined on the left: a sighting without one has no error.
    """
    best = clustered_quality(clustered).where((F.col("cluster_rank") == 1) & (F.col("quality_score") >= min_quality)).drop("cluster_rank")
    if targets is not None:
        best = best.join(targets, "frame_id", "left")
    else:
        best = best.withColumns({"target_lat": F.lit(None).cast("double"), "target_lon": F.lit(None).cast("double")})
    parsed = "points" in best.columns
    out = with_outlines(best.join(smoothed_places(clustered), "cluster")).withColumn("error_m", target_error("target_lat", "target_lon"))
    out = out if parsed else out.drop("points")
    why = rationale(*(F.col(c) for c in ("score", "angle_off_deg", "dist_m", "confidence", "cluster_size", "quality_score", "error_m", "smoothing_method")))
    out = out.withColumns({"why_selected": why, "gmaps_building": map_url(F.col("smooth_lat"), F.col("smooth_lon"))}).orderBy(F.desc("quality_score"), "cluster")
    return out.limit(top_n) if top_n else out


def report_lines(selected: DataFrame) -> DataFrame:
    """(rank, line) of a fixed-width text report."""
    s = selected.withColumn("rank", F.row_number().over(W.orderBy(F.desc("quality_score"), "cluster")))
    pad = lambda x, n: F.lpad(F.coalesce(x.cast("string"), F.lit("-")), n, " ")
    line = F.concat_ws("  ", pad(F.col("rank"), 4), pad(F.col("frame_id"), 9), pad(F.format_string("%.2f", "quality_score"), 7), pad(F.format_string("%.2f", "score"), 7), pad(F.format_string("%.1f", "dist_m"), 7), pad(F.col("error_m"), 8), F.col("why_selected"))
    return s.select("rank", line.alias("line"))

