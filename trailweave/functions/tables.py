"""Lookup tables of the street model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highway tags that make a way part of the network, in order.
RELEVANT_HIGHWAYS = (
    "trunk",
    "trunk_link",
    "primary",
    "primary_link",
    "secondary",
    "secondary_link",
    "tertiary",
    "tertiary_link",
    "unclassified",
    "residential",
    "living_street",
    "service",
    "cycleway",
    "path",
    "footway",
    "pedestrian",
    "bridleway",
    "steps",
    "track",
)
# Highway tags whose class has another name; links belong to their road's class.
CLASS_OF_HIGHWAY = {"living_street": "residential", "pedestrian": "footway", "steps": "footway", "bridleway": "path"}
ROAD_CLASS = {h: CLASS_OF_HIGHWAY.get(h, h.removesuffix("_link")) for h in RELEVANT_HIGHWAYS}
# Surface tags.
PAVED_TAGS = ("asphalt", "paved", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "metal")
UNPAVED_TAGS = (
    "gravel",
    "fine_gravel",
    "compacted",
    "pebblestone",
    "cobblestone",
    "dirt",
    "earth",
    "ground",
    "mud",
    "unpaved",
    "sand",
    "grass",
    "grass_paver",
    "wood",
    "woodchips",
)
SURFACE_OF_TAG = {t: "paved" for t in PAVED_TAGS} | {t: "unpaved" for t in UNPAVED_TAGS}
# Surface that a road class suggests; others are unknown.
SURFACE_OF_CLASS = {c: "paved" for c in ("trunk", "primary", "secondary", "tertiary", "residential", "service", "cycleway", "footway")} | {
    "track": "unpaved"
}
# Highways of trails and of roads, for crossings.
TRAIL_HIGHWAYS = ("cycleway", "path", "bridleway", "track")
ROAD_HIGHWAYS = (
    "primary",
    "primary_link",
    "secondary",
    "secondary_link",
    "tertiary",
    "tertiary_link",
    "unclassified",
    "residential",
    "living_street",
    "service",
)
# Group and rank of road classes for compatibility.
CLASS_GROUP = {
    "motorway": 0,
    "trunk": 1,
    "primary": 2,
    "secondary": 3,
    "tertiary": 4,
    "residential": 5,
    "service": 5,
    "unclassified": 5,
    "cycleway": 6,
    "path": 7,
    "footway": 7,
    "track": 8,
}
CLASS_RANK = {
    "motorway": 0,
    "trunk": 1,
    "primary": 2,
    "secondary": 3,
    "tertiary": 4,
    "residential": 5,
    "service": 6,
    "unclassified": 6,
    "cycleway": 7,
    "path": 8,
    "footway": 8,
    "track": 9,
}
# Safety of a road class; unknown classes 0.5.
CLASS_SAFETY = {
    "cycleway": 1.0,
    "path": 1.0,
    "footway": 1.0,
    "residential": 0.8,
    "service": 0.8,
    "unclassified": 0.7,
    "tertiary": 0.5,
    "secondary": 0.3,
    "track": 0.7,
    "primary": 0.15,
    "trunk": 0.0,
    "motorway": 0.0,
}
# Weights of sources in fusion, by attribute; a source that is not listed 0.5.
SOURCE_WEIGHTS = {
    "surface": {"gravelmap": 0.9, "user-report": 0.85, "osm-tag": 0.7, "mapillary": 0.65, "osm-inferred": 0.2},
    "speed-limit": {"municipal-open-data": 0.9, "google-roads": 0.85, "osm-tag": 0.8, "mapillary": 0.75, "osm-inferred": 0.15},
    "boolean": {"municipal-open-data": 0.9, "osm-tag": 0.7, "mapillary": 0.6},
    "scenic": {"user-report": 0.85, "osm-tag": 0.7},
}
# Data sources, and the attributes that observations can have.
SOURCES = ("osm-tag", "osm-inferred", "gravelmap", "mapillary", "google-roads", "municipal-open-data", "user-report")
ATTRIBUTES = ("surface", "speed-limit", "stop-sign", "traffic-signal", "road-crossing", "bicycle-infra", "traffic-calming", "scenic")
CORRIDOR_TYPES = ("trail", "path", "neighborhood", "rural-road", "collector", "arterial", "mixed")


def lookup(values: Mapping[str, object], key: Column, default: object = None) -> Column:
    """``values[key]`` as a chain of comparisons grouped by value; ``default`` for other keys."""
    by: dict[object, list[str]] = {}
    for k, v in values.items():
        by.setdefault(v, []).append(k)
    out = F
    for v, keys in by.items():
        out = out.when(key.isin(keys), F.lit(v))
    return out.otherwise(F.lit(default))
