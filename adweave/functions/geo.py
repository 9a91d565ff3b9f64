"""Distances on the map, and how far a town reaches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres in a straight line; null if a number is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def reach_km(people: Column) -> Column:
    """About how far a town's houses reach from its centre."""
    return F.greatest(F.lit(1.5), 0.6 * F.pow(people / 1000, F.lit(0.4)))


def edge_distance(km: Column, people: Column, to_centre: Column | bool = False) -> Column:
    """Kilometres to a town's edge, or to its centre."""
    to_centre = F.lit(to_centre) if isinstance(to_centre, bool) else to_centre
    return F.when(to_centre, km).otherwise(F.greatest(F.lit(0.0), km - reach_km(people)))


def edge_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, people: Column) -> tuple[Column, Column]:
    """The point of a town's edge that faces (lat1, lon1)."""
    km = haversine_km(lat1, lon1, lat2, lon2)
    part = F.when(km <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), reach_km(people) / km))
    return lat2 + (lat1 - lat2) * part, lon2 + (lon1 - lon2) * part


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees).cast("int")
