"""Great-circle distance and the unit-sphere grid used by every radius search."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon
    ) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def chord(radius_km: Column | float) -> Column:
    """Straight-line length on the unit sphere that spans ``radius_km`` of surface."""
    km = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    half = F.least(km / F.lit(2 * EARTH_RADIUS_KM), F.lit(math.pi / 2))
    # A hair wider, so that rounding in the grid can never drop a pair at exactly the radius.
    return F.greatest(F.lit(2.0) * F.sin(half) * F.lit(1.0 + 1e-9), F.lit(1e-9))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def cell_of(lat: Column, lon: Column, side: Column) -> Column:
    x, y, z = unit_xyz(lat, lon)
    return F.struct(
        F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy"), F.floor(z / side).alias("cz")
    )


def cells_around(cell: Column, reach: int = 1) -> Column:
    """The cell itself and all cells up to ``reach`` steps away, as an array to explode."""
    span = range(-reach, reach + 1)
    steps = ",".join(f"struct({x} as x, {y} as y, {z} as z)" for x in span for y in span for z in span)
    return F.transform(
        F.expr(f"array({steps})"),
        lambda s: F.struct(
            (cell.cx + s.x).alias("cx"), (cell.cy + s.y).alias("cy"), (cell.cz + s.z).alias("cz")
        ),
    )
