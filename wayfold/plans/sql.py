"""SQL that the queries' checks are made of."""

from __future__ import annotations

from ..config import SECOND_TO_FIRST, Camera
from . import views as V


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"


def mod360(x: str) -> str:
    return f"fmod(fmod({x}, 360.0::DOUBLE) + 360, 360.0::DOUBLE)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return mod360(f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))) + 360")


def diff(a: str, b: str) -> str:
    return f"abs({mod360(f'({a}) - ({b}) + 180')} - 180)"


_NEAR = f"""near AS (
  SELECT *, {haversine("lat", "lon", "b_lat", "b_lon")} AS dist_m FROM frames JOIN buildings ON abs(b_lat - lat) <= 150 / 111320.0::DOUBLE
    AND abs(b_lon - lon) <= 150 / (111320.0::DOUBLE * cos(radians(lat))) WHERE {haversine("lat", "lon", "b_lat", "b_lon")} <= 150)"""
_CONE = f"""cone AS (SELECT * FROM (SELECT *, {diff(bearing("lat", "lon", "b_lat", "b_lon"), "heading")} AS off FROM near) WHERE off <= 35)"""
_SCORED = f"""terms AS (
  SELECT *, 50 * greatest(0, 1 - pow(off / 35, 1.6)) AS ta, 30 * exp(-dist_m / 5) AS tp, 2 * degrees(atan2(footprint_w_m / 2, dist_m)) / {Camera().hfov_deg!r}::DOUBLE AS ex, 10 * exp(-abs(dist_m - depth) / 15) AS td,
    CASE WHEN dist_m > 0 THEN 15 * least(frac, ex) / greatest(frac, ex) ELSE 0 END AS tw FROM cone
), scored AS (
  SELECT frame_id, building_id, b_lat, b_lon, half, confidence, depth, round(dist_m, 2) AS dist_m, round(off, 2) AS angle_off_deg, round(ta + tp + tw + td, 2) AS score,
    round(ta, 2) AS score_angle, round(tp, 2) AS score_prox, round(tw, 2) AS score_width, round(td, 2) AS score_depth FROM terms)"""
_BEST = """best AS (
  SELECT * EXCLUDE depth FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, building_id) AS rn, count(*) OVER (PARTITION BY frame_id) AS n_candidates FROM scored) WHERE rn = 1)"""
SHIFTS = """SELECT b.*, f.lat, f.lon, f.depth, f.frac, f.lat + f.depth * cos(radians(f.heading)) / 111320 AS t_lat, f.lon + f.depth * sin(radians(f.heading)) / (111320 * cos(radians(12.945::DOUBLE))) AS t_lon FROM best b JOIN frames f USING (frame_id)"""

_STEPS = {"near": _NEAR, "cone": _CONE, "scored": _SCORED, "best": _BEST, "shifts": f"shifts AS ({SHIFTS})"}


def chain(last: str) -> str:
    """WITH the steps from the tables up to one of them."""
    names = list(_STEPS)
    return "WITH " + ",\n".join([V.FRAMES, V.BUILDINGS, *(_STEPS[n] for n in names[: names.index(last) + 1])]) + "\n"


def square_error(lat: str, lon: str) -> str:
    """To the edge of the square around b_lat, b_lon whose half side is `half` micro-degrees: 0 inside, else to the place in it that is nearest in degrees."""
    h = "half / 1e6::DOUBLE"
    clamp = lambda x, c: f"least(greatest({x}, {c} - {h}), {c} + {h})"
    return f"(CASE WHEN abs({lat} - b_lat) < {h} AND abs({lon} - b_lon) < {h} THEN 0.0::DOUBLE ELSE {haversine(lat, lon, clamp(lat, 'b_lat'), clamp(lon, 'b_lon'))} END)"


def label(e: str) -> str:
    return f"CASE WHEN {e} = 0 THEN 'INSIDE' WHEN {e} < 3 THEN 'sub-3m' WHEN {e} < 5 THEN 'excellent' WHEN {e} < 10 THEN 'good' WHEN {e} < 20 THEN 'fair' ELSE 'poor' END"


QUALITY = "100 * (0.35 * least(score, 100) / 100 + 0.25 * greatest(0, 1 - pow(angle_off_deg / 35, 1.6)) + 0.18 * exp(-pow(dist_m - 25, 2) / 648) + 0.12 * coalesce(nullif(confidence, 0), 0.5) + 0.06 * least(n_candidates, 20) / 20 + 0.04 * least(cs, 6) / 6)"

IMU_UNWRAPPED = f"""WITH {V.IMU}, st AS (SELECT *, yaw - lag(yaw) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS s FROM imu),
fx AS (SELECT *, CASE WHEN s IS NULL OR abs(s) < 180 THEN 0 WHEN s >= 180 THEN CASE WHEN s = 180 THEN 0 ELSE -360 END ELSE CASE WHEN s = -180 THEN 0 ELSE 360 END END AS fix FROM st),
unwrapped AS (SELECT *, yaw + sum(fix) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM fx)
"""


def _row(m: tuple[tuple[float, ...], ...], k: int) -> str:
    return " + ".join(f"({c!r})::DOUBLE{v}" for c, v in zip(m[k], (" * x", " * y", " * z", ""), strict=True))


def affine(k: int) -> str:
    return _row(SECOND_TO_FIRST, k)


_C = Camera()
PROJECTED = f"""WITH {V.POINTS}, cam AS (SELECT tile, n, {_row(_C.from_lidar, 0)} AS cx, {_row(_C.from_lidar, 1)} AS cy, {_row(_C.from_lidar, 2)} AS cz FROM points),
uv AS (SELECT tile, n, {_C.fx}::DOUBLE * cx / cz + {_C.cx} AS u, {_C.fy}::DOUBLE * cy / cz + {_C.cy} AS v, cz AS depth FROM cam WHERE cz > 1.5 AND cz < 80 AND abs(cx) < 50 AND cy > -1.5 AND cy < 12),
seen AS (SELECT * FROM uv WHERE u >= 0 AND u < {_C.width} AND v >= 0 AND v < {_C.height})
"""


# Geodesics on WGS-84 by Vincenty's series, with as many rounds as the column functions take.
MAJOR, FLAT = 6378137.0, "(1 / 298.257223563::DOUBLE)"
MINOR = f"({MAJOR}::DOUBLE * (1 - {FLAT}))"
_U2 = f"({MAJOR}::DOUBLE * {MAJOR}::DOUBLE - {MINOR} * {MINOR}) / ({MINOR} * {MINOR})"


def bound(name: str, value: str, body: str) -> str:
    """body with name standing for value, computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def repeated(name: str, start: str, times: int, step: str) -> str:
    """step of name applied to start so many times."""
    return f"list_reduce([{start}] || list_transform(range({times}), lambda zero: 0.0::DOUBLE), lambda {name}, other: {step})"


def _series(u: str) -> tuple[str, str]:
    return f"(1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))))", f"({u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))))"


def _arc(b: str, s: str, c: str, m: str) -> str:
    return f"({b} * {s} * ({m} + {b} / 4 * ({c} * (-1 + 2 * {m} * {m}) - {b} / 6 * {m} * (-3 + 4 * {s} * {s}) * (-3 + 4 * {m} * {m}))))"


def geodesic(a: str, b: str, c: str, d: str) -> str:
    """Metres from (a, b) to (c, d)."""
    u = lambda x: f"atan((1 - {FLAT}) * tan(radians({x})))"

    def shape(lam: str, body: str) -> str:
        x, y = f"(cos(k.q) * sin({lam}))", f"(cos(k.p) * sin(k.q) - sin(k.p) * cos(k.q) * cos({lam}))"
        arc = f"{{'s': sqrt({x} * {x} + {y} * {y}), 'c': sin(k.p) * sin(k.q) + cos(k.p) * cos(k.q) * cos({lam})}}"
        sa = f"CASE WHEN r.s = 0 THEN 0.0::DOUBLE ELSE cos(k.p) * cos(k.q) * sin({lam}) / r.s END"
        m = "CASE WHEN 1 - sa * sa <= 1e-15::DOUBLE THEN 0.0::DOUBLE ELSE r.c - 2 * sin(k.p) * sin(k.q) / (1 - sa * sa) END"
        return bound("r", arc, bound("sa", sa, bound("z", f"{{'s': r.s, 'c': r.c, 'a': sa, 'k': 1 - sa * sa, 'm': {m}}}", body)))

    f = f"({FLAT} / 16 * z.k * (4 + {FLAT} * (4 - 3 * z.k)))"
    step = shape("lam", bound("f", f, f"k.l + (1 - f) * {FLAT} * z.a * (atan2(z.s, z.c) + f * z.s * (z.m + f * z.c * (-1 + 2 * z.m * z.m)))"))
    big, small = _series("w")
    metres = bound("w", f"z.k * {_U2}", bound("b", small, f"{MINOR} * {big} * (atan2(z.s, z.c) - {_arc('b', 'z.s', 'z.c', 'z.m')})"))
    return bound("k", f"{{'p': {u(a)}, 'q': {u(c)}, 'l': radians(({d}) - ({b}))}}", bound("last", repeated("lam", "k.l", 12, step), shape("last", metres)))


def destination(lat: str, lon: str, bearing: str, metres: str) -> str:
    """{'lat', 'lon'} so many metres along the geodesic that leaves at a bearing."""
    big, small = _series("w")
    start = f"{{'u': atan((1 - {FLAT}) * tan(radians({lat}))), 'al': radians({bearing})}}"
    more = "{'u': j.u, 'al': j.al, 's1': atan2(tan(j.u), cos(j.al)), 'sa': cos(j.u) * sin(j.al)}"
    scaled = bound("w", f"(1 - h.sa * h.sa) * {_U2}", f"{{'u': h.u, 'al': h.al, 's1': h.s1, 'sa': h.sa, 's0': ({metres})::DOUBLE / ({MINOR} * {big}), 'b': {small}}}")
    step = bound("m", "cos(2 * k.s1 + s)", "k.s0 + " + _arc("k.b", "sin(s)", "cos(s)", "m"))
    x = "(sin(k.u) * sin(s) - cos(k.u) * cos(s) * cos(k.al))"
    to_lat = f"atan2(sin(k.u) * cos(s) + cos(k.u) * sin(s) * cos(k.al), (1 - {FLAT}) * sqrt(k.sa * k.sa + {x} * {x}))"
    lam = "atan2(sin(s) * sin(k.al), cos(k.u) * cos(s) - sin(k.u) * sin(s) * cos(k.al))"
    f = f"({FLAT} / 16 * (1 - k.sa * k.sa) * (4 + {FLAT} * (4 - 3 * (1 - k.sa * k.sa))))"
    turn = bound("f", f, bound("m", "cos(2 * k.s1 + s)", f"{lam} - (1 - f) * {FLAT} * k.sa * (s + f * sin(s) * (m + f * cos(s) * (-1 + 2 * m * m)))"))
    point = f"{{'lat': degrees({to_lat}), 'lon': ({lon}) + degrees({turn})}}"
    return bound("j", start, bound("h", more, bound("k", scaled, bound("s", repeated("s", "k.s0", 8, step), point))))
