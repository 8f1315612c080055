"""Distances, bearings, geodesics and offsets on the earth, in degrees and metres."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE, REFERENCE_LAT
from .basic import iterate, let, mod, round_exact

#: WGS-84.
MAJOR, FLAT = 6378137.0, 1 / 298.257223563
MINOR = MAJOR * (1 - FLAT)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))  # one use of a, so that it stays in generated code


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return mod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, 360)


def angle_diff_deg(a: Column, b: Column) -> Column:
    """The angle between two directions, 0 to 180."""
    return F.abs(mod(a - b + 180, 360) - 180)


def _series(u2: Column | np.ndarray | float) -> tuple:
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return a, b


def _arc_step(b: Column | np.ndarray | float, sin: Column | np.ndarray | float, cos: Column | np.ndarray | float, mid: Column | np.ndarray | float) -> Column | np.ndarray | float:
    return b * sin * (mid + b / 4 * (cos * (-1 + 2 * mid * mid) - b / 6 * mid * (-3 + 4 * sin * sin) * (-3 + 4 * mid * mid)))


def _ahead(lat: float | None, bearing: float | None, metres: float | None, rounds: int) -> tuple[float | None, float | None]:
    """Latitude, and degrees of longitude to go, where the geodesic ends."""
    if lat is None or bearing is None or metres is None:
        return None, None
    if not (math.isfinite(lat) and math.isfinite(bearing) and math.isfinite(metres)):
        return math.nan, math.nan
    sin, cos, atan2 = math.sin, math.cos, math.atan2
    u, al = math.atan((1 - FLAT) * math.tan(math.radians(lat))), math.radians(bearing)
    su, cu, ca = sin(u), cos(u), cos(al)
    s1, sa = atan2(math.tan(u), ca), cu * sin(al)
    c2 = 1 - sa * sa
    a, b = _series(c2 * (MAJOR**2 - MINOR**2) / MINOR**2)
    s = s0 = metres / (MINOR * a)
    for _ in range(rounds):
        s = s0 + _arc_step(b, sin(s), cos(s), cos(2 * s1 + s))
    ss, cs, m = sin(s), cos(s), cos(2 * s1 + s)
    x = su * ss - cu * cs * ca
    lam = atan2(ss * sin(al), cu * cs - su * ss * ca)
    c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
    turn = lam - (1 - c) * FLAT * sa * (s + c * ss * (m + c * cs * (-1 + 2 * m * m)))
    return math.degrees(atan2(su * cs + cu * ss * ca, (1 - FLAT) * math.sqrt(sa * sa + x * x))), math.degrees(turn)


def destination(lat: Column, lon: Column, bearing: Column, metres: Column, rounds: int = 8) -> Column:
    """struct(lat, lon) of the point so many metres along the WGS-84 geodesic that leaves at a bearing (Vincenty, fixed rounds).

    By C's sines and tangents, as engines written in C take them, number by number: Java's, and numpy's on some machines, differ from them in the last bit, and next to a tie that decides the last place of a rounded result.
    """

    @F.arrow_udf("lat double, lon double")
    def places(lat: pa.Array, lon: pa.Array, bearing: pa.Array, metres: pa.Array) -> pa.Array:
        ends = [_ahead(*r, rounds) for r in zip(*(x.to_pylist() for x in (lat, bearing, metres)), strict=True)]
        there, turn = (pa.array([e[k] for e in ends], pa.float64()) for k in (0, 1))
        return pa.StructArray.from_arrays([there, pc.add(lon, turn)], ["lat", "lon"])

    return places(*(c.cast("double") for c in (lat, lon, bearing, metres)))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 12) -> Column:
    """Metres along the WGS-84 geodesic between two points that aren't nearly opposite (Vincenty, fixed rounds)."""
    u = lambda x: F.atan((1 - FLAT) * F.tan(F.radians(x)))
    base = F.struct(u(lat1).alias("p"), u(lat2).alias("q"), F.radians(lon2 - lon1).alias("l"))

    def shape(k: Column, lam: Column) -> Column:
        """Sine and cosine of the arc, the square of the azimuth's cosine, and the sine."""
        x, y = F.cos(k.q) * F.sin(lam), F.cos(k.p) * F.sin(k.q) - F.sin(k.p) * F.cos(k.q) * F.cos(lam)
        first = F.struct(F.sqrt(x * x + y * y).alias("ss"), (F.sin(k.p) * F.sin(k.q) + F.cos(k.p) * F.cos(k.q) * F.cos(lam)).alias("cs"))

        def more(a: Column) -> Column:
            sa = F.when(a.ss == 0, 0.0).otherwise(F.cos(k.p) * F.cos(k.q) * F.sin(lam) / a.ss)
            c2 = 1 - sa * sa
            m = F.when(c2 <= 1e-15, 0.0).otherwise(a.cs - 2 * F.sin(k.p) * F.sin(k.q) / c2)
            return F.struct(a.ss.alias("ss"), a.cs.alias("cs"), sa.alias("sa"), c2.alias("c2"), m.alias("m"))

        return let(first, lambda a: let(more(a), lambda z: z))

    def step(k: Column, lam: Column) -> Column:
        def after(z: Column) -> Column:
            c = FLAT / 16 * z.c2 * (4 + FLAT * (4 - 3 * z.c2))
            return k.l + (1 - c) * FLAT * z.sa * (F.atan2(z.ss, z.cs) + c * z.ss * (z.m + c * z.cs * (-1 + 2 * z.m * z.m)))

        return let(shape(k, lam), after)

    def metres(z: Column) -> Column:
        a, b = _series(z.c2 * (MAJOR**2 - MINOR**2) / MINOR**2)
        return MINOR * a * (F.atan2(z.ss, z.cs) - _arc_step(b, z.ss, z.cs, z.m))

    return let(base, lambda k: let(iterate(k.l, rounds, lambda lam: step(k, lam)), lambda lam: let(shape(k, lam), metres)))


def geodesics(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 12) -> np.ndarray:
    """geodesic_m of whole columns, by the same rounds; a longitude that a round leaves as it is has come to its end."""
    u = lambda x: np.arctan((1 - FLAT) * np.tan(np.radians(x)))
    p, q, l = u(lat1), u(lat2), np.radians(lon2 - lon1)  # noqa: E741
    fixed = np.stack([np.sin(p), np.cos(p), np.sin(q), np.cos(q), l])

    def shape(k: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, ...]:
        sp, cp, sq, cq, _ = k
        sin, cos = np.sin(lam), np.cos(lam)
        x, y = cq * sin, cp * sq - sp * cq * cos
        ss, cs = np.sqrt(x * x + y * y), sp * sq + cp * cq * cos
        sa = np.where(ss == 0, 0.0, cp * cq * sin / ss)
        c2 = 1 - sa * sa
        return ss, cs, sa, c2, np.where(c2 <= 1e-15, 0.0, cs - 2 * sp * sq / c2)

    with np.errstate(all="ignore"):
        lam, going = l.copy(), np.arange(len(l))
        for _ in range(rounds):
            ss, cs, sa, c2, m = shape(fixed[:, going], lam[going])
            c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
            after = l[going] + (1 - c) * FLAT * sa * (np.arctan2(ss, cs) + c * ss * (m + c * cs * (-1 + 2 * m * m)))
            moved = after != lam[going]
            lam[going] = after
            going = going[moved]
        ss, cs, _, c2, m = shape(fixed, lam)
        a, b = _series(c2 * (MAJOR**2 - MINOR**2) / MINOR**2)
        return MINOR * a * (np.arctan2(ss, cs) - _arc_step(b, ss, cs, m))


def shifted(lat: Column, lon: Column, heading: Column, depth: Column, along: Column, cross: Column) -> Column:
    """struct(lat, lon) of the target at depth + along ahead (1 m at least) and cross to the right, on a flat earth at REFERENCE_LAT."""

    def at(d: Column) -> Column:
        h = F.radians(heading + F.degrees(F.atan2(cross, d)))
        per_lon = METRES_PER_DEGREE * F.cos(F.radians(F.lit(REFERENCE_LAT)))
        return F.struct((lat + d * F.cos(h) / METRES_PER_DEGREE).alias("lat"), (lon + d * F.sin(h) / per_lon).alias("lon"))

    return let(F.greatest(F.lit(1.0), depth + along), at)


def map_url(lat: Column, lon: Column, base: str = "https://www.google.com/maps/search/?api=1&query=") -> Column:
    """An address with both to 8 places, rounded by their exact binary values: Java's formatter rounds the shortest text of a number, which may be a tie where the number isn't one."""
    text = lambda x: F.format_string("%.8f", F.when((F.abs(x) < 4e7) & (F.abs(x) >= 1e-8), round_exact(x, 8)).otherwise(x))
    return F.concat(F.lit(base), text(lat), F.lit(","), text(lon))


def cell_key(lat: Column, lon: Column) -> Column:
    """The key of what lies at the same place to five decimals: whole numbers, which round alike everywhere; place_text writes them."""
    return F.struct(F.round(lat * 1e5).cast("long").alias("lat_e5"), F.round(lon * 1e5).cast("long").alias("lon_e5"))


def place_text(key: Column) -> Column:
    return F.concat(F.format_string("%.5f", key.lat_e5 / 1e5), F.lit("_"), F.format_string("%.5f", key.lon_e5 / 1e5))
