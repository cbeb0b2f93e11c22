"""Great-circle distance and implied speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(chord))


def speed_kmh(km: Column, start: Column, end: Column) -> Column:
    """Speed over whole elapsed seconds; NULL when no second has passed."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return km / F.nullif(seconds / 3600.0, F.lit(0.0))
