"""Rectangles and circles on latitude and longitude, as expressions whose boxes reach the scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def cell(value: Column, step: float) -> Column:
    """The number of the grid line at or below a coordinate."""
    return F.floor(value / step).cast("int")


def in_rectangle(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def haversine_km(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    """Great-circle distance on a sphere of 6371 km radius."""
    dlat, dlng = F.radians(lat - at_lat) / 2, F.radians(lng - at_lng) / 2
    a = F.sin(dlat) * F.sin(dlat) + math.cos(math.radians(at_lat)) * F.cos(F.radians(lat)) * F.sin(dlng) * F.sin(dlng)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bounding_box(at_lat: float, at_lng: float, km: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a circle; all longitudes if it holds a pole or crosses the date line."""
    span = math.degrees(km / EARTH_KM)
    south, north = max(-90.0, at_lat - span), min(90.0, at_lat + span)
    if at_lat - span <= -90 or at_lat + span >= 90:
        return south, north, -180.0, 180.0
    wide = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / math.cos(math.radians(at_lat)))))
    if km > EARTH_KM * math.pi / 2 or at_lng - wide < -180 or at_lng + wide > 180:
        return south, north, -180.0, 180.0
    return south, north, at_lng - wide, at_lng + wide


def within_circle(rows: DataFrame, lat: str, lng: str, at_lat: float, at_lng: float, km: float) -> DataFrame:
    """Rows within `km` of a point, with `distance_km`; the box comes first, so that the scan can skip row groups."""
    south, north, west, east = bounding_box(at_lat, at_lng, km)
    boxed = rows.where(in_rectangle(F.col(lat), F.col(lng), south - 1e-9, north + 1e-9, west - 1e-9, east + 1e-9))
    return boxed.withColumn("distance_km", haversine_km(F.col(lat), F.col(lng), at_lat, at_lng)).where(F.col("distance_km") <= km)


def map_place(lat: Column, lng: Column, west: float = -81.0, width: float = 13.0, south: float = -18.0, height: float = 15.0) -> tuple[Column, Column]:
    """Place on a map in percent: from the left, from the top."""
    return (lng - west) / width * 100, (lat - south) / height * 100
