"""Parameters of the pipeline, as immutable records that operators take as arguments."""

from __future__ import annotations

import math
from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
# The reference latitude, the curated frames and the frames' timing.
#: The latitude at which flat-earth shifts take a degree of longitude.
REFERENCE_LAT = 12.945
CURATED_FRAMES = (76, 151, 226, 276, 401, 626, 1826, 3351)


@dataclass(frozen=True)
class Frames:
    start: int = 1
    end: int = 3599
    fps: float = 30.0
    step: int = 25


# The calibrated camera and the rigid transforms between sensors.
@dataclass(frozen=True)
class Camera:
    width: int = 3840
    height: int = 2160
    fx: float = 1106.46
    fy: float = 1077.77
    cx: float = 1920.0
    cy: float = 1080.0
    from_lidar: tuple[tuple[float, ...], ...] = (
        (0.20927, -0.977663, -0.0195126, 2.05416),
        (0.0386136, 0.0282009, -0.998856, 0.401883),
        (0.977095, 0.208277, 0.0436527, -0.035744),
    )

    @property
    def hfov_deg(self) -> float:
        return math.degrees(2 * math.atan2(self.width / 2, self.fx))


SECOND_TO_FIRST = (
    (0.9997594356536865, 0.020968914031982422, -0.0064355251379311085, -0.11370490491390228),
    (-0.021027371287345886, 0.9997369647026062, -0.009154382161796093, 0.9193867444992065),
    (0.006241875234991312, 0.009287501685321331, 0.9999374151229858, -0.001643864088691771),
)


# How candidates are sought and scored.
@dataclass(frozen=True)
class Matching:
    radius_m: float = 150.0
    cone_deg: float = 35.0
    min_confidence: float = 0.0
    angle_max: float = 50.0
    proximity_max: float = 30.0
    width_max: float = 15.0
    depth_max: float = 10.0
    decay_m: float = 5.0


# When tracks begin, go on and end.
@dataclass(frozen=True)
class Tracking:
    gate: float = 45.0
    min_update: float = 38.0
    min_start: float = 48.0
    reach_m: float = 18.0
    cap_m: float = 40.0
    max_misses: int = 3
    min_hits: int = 2
    candidates: int = 4


# The offsets that calibration tries, and when it stops.
@dataclass(frozen=True)
class Grid:
    """Offsets to try: the along axis is the outer one."""

    along_start: float = 25.0
    along_step: float = 0.5
    along_n: int = 60
    cross_start: float = -6.0
    cross_step: float = 0.2
    cross_n: int = 60
    floor_m: float = 4.5
    outlier_scale: float = 2.0
    goal_m: float = 3.0
