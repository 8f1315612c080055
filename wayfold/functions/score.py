"""Scores and the labels and phrases that tell of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Camera, Matching
from .basic import let


def _falloff(off: Column, cone: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.pow(off / cone, 1.6))


def _proximity(dist: Column, m: Matching) -> Column:
    return m.proximity_max * F.exp(-dist / m.decay_m)


def _agreement(dist: Column, depth: Column, m: Matching) -> Column:
    return F.coalesce(F.when(depth > 0, m.depth_max * F.exp(-F.abs(dist - depth) / 15)), F.lit(0.0))


def match_bound(dist: Column, depth: Column, m: Matching = Matching()) -> Column:
    """What the terms of match_terms come to at most at a distance, whatever angle and width are."""
    return m.angle_max + m.width_max + _proximity(dist, m) + _agreement(dist, depth, m)


def match_terms(off: Column, dist: Column, width: Column, frac: Column, depth: Column, m: Matching = Matching(), camera: Camera = Camera()) -> Column:
    """struct(angle, prox, width, depth), unrounded: how well a building fits what was seen. A missing or zero footprint, distance or depth gives 0."""
    expected = 2 * F.degrees(F.atan2(width / 2, dist)) / camera.hfov_deg
    fits = let(expected, lambda e: F.when(e > 0, m.width_max * F.least(frac, e) / F.greatest(frac, e)))
    return F.struct(
        (m.angle_max * _falloff(off, m.cone_deg)).alias("angle"),
        _proximity(dist, m).alias("prox"),
        F.coalesce(F.when((width > 0) & (dist > 0), fits), F.lit(0.0)).alias("width"),
        _agreement(dist, depth, m).alias("depth"),
    )


def quality(score: Column, off: Column, dist: Column, confidence: Column, candidates: Column, sightings: Column) -> Column:
    """0 to 100, unrounded. A missing or zero confidence counts as a half."""
    conf = F.coalesce(F.nullif(confidence.cast("double"), F.lit(0.0)), F.lit(0.5))
    return 100 * (
        0.35 * F.least(score, F.lit(100.0)) / 100
        + 0.25 * _falloff(off, 35.0)
        + 0.18 * F.exp(-F.pow(dist - 25, 2) / (2 * 18.0**2))
        + 0.12 * conf
        + 0.06 * F.least(candidates, F.lit(20)) / 20
        + 0.04 * F.least(sightings, F.lit(6)) / 6
    )


def _banded(x: Column, bands: list[tuple[float, str]], last: str) -> Column:
    out = F.when(x < bands[0][0], bands[0][1])
    for top, label in bands[1:]:
        out = out.when(x < top, label)
    return out.otherwise(last)


def accuracy_label(error: Column) -> Column:
    return F.when(error.isNull(), "unknown").when(error == 0, "INSIDE").otherwise(_banded(error, [(3, "sub-3m"), (5, "excellent"), (10, "good"), (20, "fair")], "poor"))


def distance_label(error: Column) -> Column:
    return F.when(error.isNull(), None).otherwise(_banded(error, [(15, "GOOD"), (40, "HIGH")], "LARGE"))


def error_chip(error: Column, edges: tuple[float, ...] = (5, 10, 20)) -> Column:
    """inside, then the first of the edges that the error is below, as a number."""
    out = F.when(error.isNull(), None).when(error == 0, "inside")
    for e in edges:
        out = out.when(error < e, f"under_{e:g}")
    return out.otherwise("beyond")


def score_colour(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 60, "lime").when(score >= 45, "amber").otherwise("red")


def change_text(raw: Column, corrected: Column) -> Column:
    """By how many percent of raw it got better or worse; null where either is null or raw is 0."""
    pct = 100 * (raw - corrected) / F.nullif(raw, F.lit(0.0))
    return F.when(pct.isNull(), None).when(pct >= 0, F.format_string("%.0f%% better", pct)).otherwise(F.format_string("%.0f%% worse", -pct))


def improvement_pct(raw: Column, corrected: Column) -> Column:
    return F.coalesce(100 * (raw - corrected) / F.nullif(raw, F.lit(0.0)), F.lit(0.0))


# The thresholds of labels and chips above, and the phrases below with theirs.
def rationale(score: Column, off: Column, dist: Column, confidence: Column, sightings: Column, q: Column, error: Column, method: Column) -> Column:
    """Why a sighting was selected, in phrases parted by semicolons."""
    n = lambda fmt, x: F.format_string(fmt, x.cast("double"))
    phrases = F.concat_ws(
        "; ",
        F.when(score >= 70, n("high GOB match (%.1f/100)", score)).when(score >= 55, n("good GOB match (%.1f/100)", score)).otherwise(n("moderate GOB match (%.1f/100)", score)),
        F.when(off <= 5, n("near-perfect heading (%.1f°)", off)).when(off <= 15, n("good heading (%.1f°)", off)).otherwise(n("off-heading (%.1f°)", off)),
        F.when(dist.between(15, 40), n("optimal range (%.0f m)", dist)).when(dist < 15, n("very close (%.0f m)", dist)).otherwise(n("long range (%.0f m)", dist)),
        F.when(confidence >= 0.8, n("high GOB confidence (%.0f%%)", 100 * confidence)),
        F.when(sightings >= 3, F.concat(F.lit("stable ("), sightings.cast("string"), F.lit("-frame cluster)"))),
    )
    edge = F.coalesce(n("%.1f m", error), F.lit("N/A"))
    return F.concat(phrases, n(". Quality=%.1f/100", q), F.lit(" · edge-error="), edge, F.lit(" · GPS="), method, F.lit("."))
