"""Coordinates: validation, distance and the proximity score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.text import blank_to_null, leading_number


def validate_coordinates(raw_lat: Column, raw_lng: Column) -> Column:
    """struct(valid, latitude, longitude, issue)."""
    lat, lng = leading_number(raw_lat), leading_number(raw_lng)
    missing = blank_to_null(raw_lat).isNull() | blank_to_null(raw_lng).isNull()
    out = (F.abs(lat) > 90) | (F.abs(lng) > 180)
    inside = F.lit(False)
    for _, lat_min, lat_max, lng_min, lng_max in K.US_BOXES:
        inside = inside | (lat.between(lat_min, lat_max) & lng.between(lng_min, lng_max))
    issue = (
        F.when(missing, "missing_coordinates")
        .when(lat.isNull() | lng.isNull(), "non_numeric")
        .when(out, "out_of_global_bounds")
        .when((lat == 0) & (lng == 0), "zero_coordinates")
        .when(~inside, "outside_us")
    )
    keep = issue.isNull() | issue.isin("out_of_global_bounds", "outside_us")
    return F.struct(
        issue.isNull().alias("valid"),
        F.when(keep, lat).alias("latitude"),
        F.when(keep, lng).alias("longitude"),
        issue.alias("issue"),
    )


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    half = F.sin(d_lat / 2) * F.sin(d_lat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        d_lng / 2
    ) * F.sin(d_lng / 2)
    return F.lit(K.EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(half), F.sqrt(1 - half))


def proximity_score(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return proximity_points(haversine(lat1, lng1, lat2, lng2))


def proximity_points(distance: Column) -> Column:
    score = F.when(distance < K.GEO_STEPS[0][0], K.GEO_STEPS[0][1])
    for limit, points in K.GEO_STEPS[1:]:
        score = score.when(distance < limit, points)
    return score.otherwise(0)


def on_sphere(lat: Column, lng: Column) -> dict[str, Column]:
    """A point on the unit sphere; of two points the straight line between them follows without trigonometry."""
    flat = F.cos(F.radians(lat))
    return {"x": flat * F.cos(F.radians(lng)), "y": flat * F.sin(F.radians(lng)), "z": F.sin(F.radians(lat))}


def square_chord(metres: float) -> float:
    """The square of the straight line on the unit sphere under which points are so far apart, with room for rounding."""
    return (2 * math.sin(metres / (2 * K.EARTH_RADIUS_M))) ** 2 * (1 + 1e-6)


# --- grid for the distance join --------------------------------------------------------------

REACH_M = float(K.GEO_STEPS[-1][0])
# A band is slightly wider than the reach, so neighbours are always in the next band at most.
BAND_DEG = REACH_M / 111_000.0
POLE_GUARD = 0.02


def band(lat: Column) -> Column:
    return F.floor(lat / BAND_DEG).cast("int")


def band_cells(lat: Column, row: int) -> Column:
    """Number of cells in the band ``row`` away from the point's own.

    A cell is wide enough to cover the reach anywhere in the bands next to it. Close
    to a pole the whole band is one cell.
    """
    b = band(lat) + row
    far = F.least(F.greatest(F.abs(b - 1), F.abs(b + 2)) * BAND_DEG, F.lit(90.0))
    shrink = F.cos(F.radians(far))
    return F.when(shrink > POLE_GUARD, F.floor(360.0 * shrink / BAND_DEG)).otherwise(1)


def cell_name(b: Column, cells: Column, lng: Column, shift: Column) -> Column:
    """Cell ``shift`` steps east of the point's, in band ``b`` cut into ``cells`` equal cells.

    Null where the band is a single cell and a shift would only repeat it.
    """
    index = F.least(F.floor((lng + 180.0) / 360.0 * cells), cells - 1)
    return F.when((cells > 1) | (shift == 0), F.concat_ws(":", b, F.pmod(index + shift, cells)))


def on_globe(lat: Column, lng: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
