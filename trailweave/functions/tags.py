"""Attributes of ways from their tags (``map<string,string>``), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.numbers import leading_int, round_half_up
from trailweave.functions.tables import RELEVANT_HIGHWAYS, ROAD_CLASS, SURFACE_OF_CLASS, SURFACE_OF_TAG, lookup

TAGGED, INFERRED = 0.8, 0.3


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _is(value: Column, *names: str) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def is_relevant(tags: Column) -> Column:
    """Whether a way belongs to the network; the activities asked for make no difference."""
    return _is(tag(tags, "highway"), *RELEVANT_HIGHWAYS)


def road_class(tags: Column) -> Column:
    return F.coalesce(lookup(ROAD_CLASS, tag(tags, "highway")), F.lit("unclassified"))


def surface(tags: Column, klass: Column) -> tuple[Column, Column]:
    """Surface and its confidence: the tag's, or what the road class suggests."""
    told = lookup(SURFACE_OF_TAG, tag(tags, "surface"))
    return (
        F.coalesce(told, lookup(SURFACE_OF_CLASS, klass), F.lit("unknown")),
        F.when(told.isNotNull(), F.lit(TAGGED)).otherwise(F.lit(INFERRED)),
    )


def infrastructure(tags: Column) -> dict[str, Column]:
    """The five flags; never null."""
    highway, bicycle = tag(tags, "highway"), tag(tags, "bicycle")
    lanes = [tag(tags, k) for k in ("cycleway", "cycleway:left", "cycleway:right", "cycleway:both")]

    def lane(*names: str) -> Column:
        out = F.lit(False)
        for value in lanes:
            out = out | _is(value, *names)
        return out

    calming = tag(tags, "traffic_calming")
    return {
        "has_bicycle_infra": _is(highway, "cycleway")
        | lane("lane", "track", "shared_lane", "shared_busway")
        | _is(bicycle, "designated")
        | _is(tag(tags, "bicycle_road"), "yes")
        | _is(tag(tags, "cyclestreet"), "yes"),
        "has_pedestrian_path": _is(highway, "footway", "pedestrian") | (_is(highway, "path") & ~_is(bicycle, "designated")),
        "has_shoulder": _is(tag(tags, "shoulder"), "yes", "both", "left", "right"),
        "is_separated": _is(highway, "cycleway", "path", "footway", "pedestrian")
        | lane("track", "separate")
        | _is(tag(tags, "segregated"), "yes")
        | _is(tag(tags, "sidewalk"), "separate"),
        "has_traffic_calming": (calming.isNotNull() & ~_is(calming, "no")) | _is(highway, "living_street"),
    }


def one_way(tags: Column) -> Column:
    return _is(tag(tags, "junction"), "roundabout") | _is(tag(tags, "oneway"), "yes", "true", "1", "-1", "reverse")


def reversed_one_way(tags: Column) -> Column:
    return _is(tag(tags, "oneway"), "-1", "reverse")


def speed_limit(tags: Column) -> Column:
    """Kilometres an hour; null if there is none or it is not a number."""
    text = tag(tags, "maxspeed")
    shape = r"(?i)^([0-9]+)\s*(mph|km/h|kmh)?$"
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    miles = F.lower(F.regexp_extract(text, shape, 2)) == "mph"
    return (
        F.when(text.isin("walk", "walking"), F.lit(5.0))
        .when(text.isNull() | (text == "none"), F.lit(None).cast("double"))
        .when(miles, round_half_up(number * 1.60934))
        .otherwise(number)
    )


def lanes(tags: Column) -> Column:
    return leading_int(tag(tags, "lanes"))


def name(tags: Column) -> Column:
    return F.coalesce(tag(tags, "name"), tag(tags, "ref"), tag(tags, "official_name"))


def scenic(tags: Column) -> Column:
    return _is(tag(tags, "scenic"), "yes")


def counterpart(edge_id: Column) -> Column:
    """The id of a two-way edge's other direction; null for others."""
    stem = F.substring(edge_id, F.lit(1), F.char_length(edge_id) - 1)
    return F.when(edge_id.endswith(":f"), F.concat(stem, F.lit("r"))).when(edge_id.endswith(":r"), F.concat(stem, F.lit("f")))
