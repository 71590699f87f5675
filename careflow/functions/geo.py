"""Distances and area codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careflow import fixed_values as fv


def haversine_km(
    lat1: Column,
    lon1: Column,
    lat2: Column,
    lon2: Column,
    radius: float = fv.EARTH_RADIUS_KM,
    same_place: float = fv.SAME_PLACE_KM,
) -> Column:
    """Great-circle distance; two equal points count as ``same_place`` kilometres apart."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    km = F.lit(2 * radius) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
    return F.when(km == 0, F.lit(same_place)).otherwise(km)


def normalize_area_code(col: Column | str) -> Column:
    """Area code without its trailing check digit."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / 10).cast("long")
