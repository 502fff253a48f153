"""Geographic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial radius in metres, the one of the reference results.
EQUATOR_M = 6378137.0


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres; null if a value is missing or out of range."""
    ok = F.lit(True)
    for lon, lat in ((lon1, lat1), (lon2, lat2)):
        ok = ok & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(ok, F.lit(2 * EQUATOR_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def in_rings(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point lies in any of some rings, by edge crossings in the plane. For a few small rings given as values; tables of
    regions go through operators.spatial."""
    hit = F.lit(False)
    for ring in rings:
        odd = F.lit(False)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 == y2:
                continue
            cross = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
            odd = odd != (cross & (lon < F.lit(float(x2 - x1)) * (lat - float(y1)) / float(y2 - y1) + float(x1)))
        hit = hit | odd
    return hit
