"""Geometry on latitude and longitude as Column expressions.

Geometries are ``array<struct<lat:double,lng:double>>``. Everything here stays in generated
code; the one recursive operation, simplification, is in ``operators.lines``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M, DEGREE_KM = 6_371_000.0, 111_320.0, 111.32


def _h(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), _h(lat1, lng1, lat2, lng2))))


def haversine_atan(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same by the two-argument arc tangent."""
    h = _h(lat1, lng1, lat2, lng2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def points_distance(a: Column, b: Column) -> Column:
    return haversine(a["lat"], a["lng"], b["lat"], b["lng"])


def steps(geometry: Column) -> Column:
    """Array of (a, b) of consecutive points."""
    n = F.size(geometry)
    return F.when(
        n > 1, F.arrays_zip(F.slice(geometry, 1, n - 1).alias("a"), F.slice(geometry, 2, n - 1).alias("b"))
    ).otherwise(F.expr("CAST(array() AS array<struct<a:struct<lat:double,lng:double>,b:struct<lat:double,lng:double>>>)"))


def path_length(geometry: Column) -> Column:
    """Length of a line in metres; 0 with fewer than two points."""
    n = F.size(geometry)
    a, b = F.slice(geometry, 1, F.greatest(n - 1, F.lit(0))), F.slice(geometry, 2, F.greatest(n - 1, F.lit(0)))
    return F.aggregate(F.zip_with(a, b, points_distance), F.lit(0.0), lambda s, d: s + d)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def exit_bearing(geometry: Column) -> Column:
    """Bearing of a line's last step; 0 with fewer than two points."""
    a, b = F.element_at(geometry, -2), F.element_at(geometry, -1)
    return F.when(F.size(geometry) >= 2, bearing(a["lat"], a["lng"], b["lat"], b["lng"])).otherwise(F.lit(0.0))


def entry_bearing(geometry: Column) -> Column:
    """Bearing of a line's first step; 0 with fewer than two points."""
    a, b = F.get(geometry, F.lit(0)), F.get(geometry, F.lit(1))
    return F.when(F.size(geometry) >= 2, bearing(a["lat"], a["lng"], b["lat"], b["lng"])).otherwise(F.lit(0.0))


def turn(a: Column, b: Column) -> Column:
    """Difference of two bearings, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def flat_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in metres on a plane, scaled at the middle latitude of the pair."""
    x = (lng1 - lng2) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat1 - lat2) * DEGREE_M
    return F.sqrt(x * x + y * y)


def segment_distance(lat: Column, lng: Column, a: Column, b: Column, cos_lat: Column | None = None) -> Column:
    """Distance in metres of a point from the segment a-b on a plane; the longitude is scaled by
    ``cos_lat``, or else at the segment's middle latitude."""
    scale = (F.cos(F.radians((a["lat"] + b["lat"]) / 2)) if cos_lat is None else cos_lat) * DEGREE_M
    px, py = (lng - a["lng"]) * scale, (lat - a["lat"]) * DEGREE_M
    dx, dy = (b["lng"] - a["lng"]) * scale, (b["lat"] - a["lat"]) * DEGREE_M
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length))).otherwise(F.lit(0.0))
    ex, ey = px - t * dx, py - t * dy
    return F.sqrt(ex * ex + ey * ey)


def line_distance(lat: Column, lng: Column, geometry: Column, cos_lat: Column) -> Column:
    """Least distance of a point from a line's segments (from its point if it has one); null if empty."""
    n = F.size(geometry)
    a, b = F.slice(geometry, 1, F.greatest(n - 1, F.lit(1))), F.slice(geometry, F.least(n, F.lit(2)), F.greatest(n - 1, F.lit(1)))
    return F.when(n > 0, F.array_min(F.zip_with(a, b, lambda p, q: segment_distance(lat, lng, p, q, cos_lat))))


def box_around(lat: Column, lng: Column, km: Column) -> dict[str, Column]:
    """Bounds ``km`` from a centre on all sides."""
    d = km / DEGREE_KM
    e = d / F.cos(F.radians(lat))
    return {"min_lat": lat - d, "max_lat": lat + d, "min_lng": lng - e, "max_lng": lng + e}


def box_grown(box: dict[str, Column], km: Column) -> dict[str, Column]:
    """Bounds moved out by ``km``, the longitude scaled at the middle latitude."""
    d = km / DEGREE_KM
    e = d / F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2))
    return {"min_lat": box["min_lat"] - d, "max_lat": box["max_lat"] + d, "min_lng": box["min_lng"] - e, "max_lng": box["max_lng"] + e}


def touches_box(geometry: Column, box: dict[str, Column]) -> Column:
    """Whether a point of the line lies in the bounds, edges included."""
    return F.exists(geometry, lambda p: p["lat"].between(box["min_lat"], box["max_lat"]) & p["lng"].between(box["min_lng"], box["max_lng"]))


def cell(lat: Column, lng: Column, mean_lat: Column, metres: float = 100.0) -> tuple[Column, Column]:
    """Grid cell (x, y) of a point, with the longitude scaled at ``mean_lat``."""
    x = F.floor(lng * DEGREE_M * F.cos(F.radians(mean_lat)) / metres)
    y = F.floor(lat * DEGREE_M / metres)
    return x.cast("long"), y.cast("long")


def appended(line: Column, points: Column, tolerance: float = 1e-8) -> Column:
    """``line`` and the points that differ from the one before them by more than ``tolerance`` degrees."""
    return F.aggregate(
        points,
        line,
        lambda s, p: F.when(
            (F.size(s) > 0)
            & (F.abs(F.element_at(s, -1)["lat"] - p["lat"]) < tolerance)
            & (F.abs(F.element_at(s, -1)["lng"] - p["lng"]) < tolerance),
            s,
        ).otherwise(F.concat(s, F.array(p))),
    )


def joined(lines: Column) -> Column:
    """Lines end to end; a line's first point goes where it equals the point before it."""
    empty = F.expr("CAST(array() AS array<struct<lat:double,lng:double>>)")
    return F.aggregate(
        lines,
        empty,
        lambda s, g: F.when(
            (F.size(s) > 0) & (F.size(g) > 0) & (F.element_at(s, -1) == F.get(g, F.lit(0))), F.concat(s, F.slice(g, 2, F.size(g)))
        ).otherwise(F.concat(s, g)),
    )
