"""Box arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geosieve.functions import geo

CORNERS = ("x1", "y1", "x2", "y2")


def center(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return (F.col(x1) + F.col(x2)) / 2.0, (F.col(y1) + F.col(y2)) / 2.0


def has_all_corners() -> Column:
    present = F.lit(True)
    for name in CORNERS:
        present = present & F.col(name).isNotNull()
    return present


def is_inside(size: float) -> Column:
    """0 <= x1 < x2 <= size and the same for y; a missing corner is not inside."""
    ok = (
        (F.col("x1") >= 0) & (F.col("x1") < F.col("x2")) & (F.col("x2") <= size)
        & (F.col("y1") >= 0) & (F.col("y1") < F.col("y2")) & (F.col("y2") <= size)
    )
    return F.coalesce(ok, F.lit(False))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 when the boxes do not overlap."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = width * height
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = area_a + area_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def geolocate(left, top, cx: Column, cy: Column, world_size) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel inside a patch."""
    return (
        geo.world_lat(F.col(top) + cy, world_size),
        geo.world_lon(F.col(left) + cx, world_size),
    )


def normalised(size: float) -> dict[str, Column]:
    """Centre and extent as fractions of the image side."""
    cx, cy = center()
    return {
        "x_center_norm": cx / size,
        "y_center_norm": cy / size,
        "width_norm": (F.col("x2") - F.col("x1")) / size,
        "height_norm": (F.col("y2") - F.col("y1")) / size,
    }


def label_line(parts: dict[str, Column]) -> Column:
    """One label line, class 0 then four numbers of eight decimals.

    ``bround`` first: the eighth decimal of n/512 and n/1024 ties, and the label
    format rounds ties to even.
    """
    numbers = [F.bround(value, 8) for value in parts.values()]
    return F.format_string("0 %.8f %.8f %.8f %.8f\n", *numbers)


def offset_from_center_m(cx, cy, width, height, ground_m: float) -> Column:
    """Metres from the image centre when the image covers ground_m per side."""
    dx = (cx - width / 2.0) * (F.lit(float(ground_m)) / width)
    dy = (cy - height / 2.0) * (F.lit(float(ground_m)) / height)
    return F.sqrt(dx * dx + dy * dy)
