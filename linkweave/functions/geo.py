"""Coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6372.0
SAME_KM = 0.003


def point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) of doubles; null if either does not parse."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon")))


def valid(p: Column) -> Column:
    """Within the open intervals (-90, 90) and (-180, 180); false for null and NaN."""
    lat, lon = p["lat"], p["lon"]
    return F.coalesce((lat > -90) & (lat < 90) & (lon > -180) & (lon < 180), F.lit(False))


def distance(a: Column, b: Column, axis: str = "reference") -> Column:
    """Kilometres by the spherical law of cosines. axis='reference' takes the first
    coordinate for the longitude, as the behaviour to match does; 'latlon' is the
    true distance."""
    first, second = ("lon", "lat") if axis == "reference" else ("lat", "lon")
    y1, x1, y2, x2 = (F.radians(p[c]) for p in (a, b) for c in (first, second))
    cos = F.sin(y1) * F.sin(y2) + F.cos(y1) * F.cos(y2) * F.cos(x2 - x1)
    km = F.when(cos >= 1, 0.0).otherwise(F.lit(RADIUS_KM) * F.acos(F.greatest(cos, F.lit(-1.0))))
    return F.when(km <= SAME_KM, 0.0).otherwise(km)


def similarity(a: Column, b: Column, near: float = 0.0, far: float = 3.0, missing: float | None = None, axis: str = "reference") -> Column:
    """1 up to `near`, 0 from `far`, linear between; `missing` for an invalid point."""
    if not 0 <= near < far:
        raise ValueError(f"near {near}, far {far}")
    d = distance(a, b, axis)
    s = F.when(d <= near, 1.0).when(d >= far, 0.0).otherwise(1.0 - (d - near) / F.lit(float(far - near)))
    return F.when(valid(a) & valid(b), s).otherwise(F.lit(missing).cast("double"))
