"""Distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import constants as C


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km, arctangent form."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(C.EARTH_RADIUS_KM) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))

