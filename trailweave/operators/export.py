"""GeoJSON features and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.geo import appended
from trailweave.functions.numbers import clamp, round_half_up
from trailweave.functions.scoring import DIMENSIONS
from trailweave.functions.tables import lookup
from trailweave.operators.corridors import Network
from trailweave.operators.ranks import at_fractions

# Colours and widths.
TYPE_COLOURS = {
    "trail": "#2ecc71",
    "path": "#27ae60",
    "neighborhood": "#3498db",
    "rural-road": "#1abc9c",
    "collector": "#f39c12",
    "arterial": "#e74c3c",
    "mixed": "#9b59b6",
}
TYPE_WIDTHS = {"trail": 4.0, "path": 3.0, "arterial": 3.0, "collector": 2.5, "neighborhood": 2.0, "rural-road": 2.0, "mixed": 2.0}
CONNECTOR_COLOUR, FALLBACK_COLOUR = "#95a5a6", "#888888"
#: Of a route: paved and unpaved, of the first route and of others.
ROUTE_COLOURS = {True: ("#2563eb", "#d97706"), False: ("#9333ea", "#b45309")}


def score_colour(score: Column) -> Column:
    """Red over yellow to green as #rrggbb."""
    s = clamp(score)
    hexed = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")
    red = F.when(s < 0.5, F.lit(204.0)).otherwise(round_half_up(204 - (s - 0.5) / 0.5 * 170))
    green = F.when(s < 0.5, round_half_up(34 + s / 0.5 * 170)).otherwise(F.lit(204.0))
    return F.concat(F.lit("#"), hexed(red), hexed(green), F.lit("22"))


def coordinates(geometry: Column) -> Column:
    return F.transform(geometry, lambda p: F.array(p["lng"], p["lat"]))


def _json(required: dict[str, Column], optional: dict[str, Column] | None = None) -> Column:
    """An object as text: ``required`` members with their nulls, ``optional`` ones only where they are not null."""
    whole = lambda members: F.struct(*[v.alias(k) for k, v in members.items()])
    first = F.to_json(whole(required), {"ignoreNullFields": "false"})
    if not optional:
        return first
    rest = F.to_json(whole(optional))
    return F.when(rest == "{}", first).otherwise(F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))


def _feature(geometry: Column, properties: Column, kind: str = "LineString") -> Column:
    place = coordinates(geometry) if kind == "LineString" else F.array(geometry["lng"], geometry["lat"])
    line = F.to_json(F.struct(F.lit(kind).alias("type"), place.alias("coordinates")))
    return F.concat(F.lit('{"type":"Feature","geometry":'), line, F.lit(',"properties":'), properties, F.lit("}"))


def _rounded(name: str, digits: int = 0) -> Column:
    value = round_half_up(F.col(name), digits)
    return value if digits else value.cast("long")


def score_range(scores: DataFrame) -> DataFrame:
    """One row ``p5, p95`` of ``overall``, nulls unless the latter is larger."""
    both = at_fractions(scores, "overall", {"p5": 0.05, "p95": 0.95})
    ok = F.col("p95") > F.col("p5")
    return both.select(F.when(ok, F.col("p5")).alias("p5"), F.when(ok, F.col("p95")).alias("p95"))


def street_features(
    edges: DataFrame,
    road_classes: tuple[str, ...] | None = None,
    surfaces: tuple[str, ...] | None = None,
    min_confidence: float | None = None,
    one_direction: bool = False,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """``id, feature``: a line for each edge, and a point for each of ``nodes``. With ``one_direction`` the
    first of the edges between two nodes on a way stands for them, chosen before the other filters."""
    rows = edges
    if one_direction:
        pair = Window.partitionBy(F.least("from_node", "to_node"), F.greatest("from_node", "to_node"), "osm_way_id").orderBy("seq")
        rows = rows.withColumn("_n", F.row_number().over(pair)).where("_n = 1")
    if road_classes:
        rows = rows.where(F.col("road_class").isin(*road_classes))
    if surfaces:
        rows = rows.where(F.col("surface").isin(*surfaces))
    if min_confidence is not None:
        rows = rows.where(F.col("surface_confidence") >= min_confidence)
    c = F.col
    properties = {
        "id": c("id"),
        "osmWayId": c("osm_way_id"),
        "name": c("name"),
        "roadClass": c("road_class"),
        "surface": c("surface"),
        "surfaceConfidence": _rounded("surface_confidence", 2),
        "hasConflict": c("surface_conflict"),
        "lengthMeters": _rounded("length_m"),
        "oneWay": c("one_way"),
        "lanes": c("lanes"),
        "speedLimit": c("speed_limit"),
        "hasBicycleInfra": c("has_bicycle_infra"),
        "hasPedestrianPath": c("has_pedestrian_path"),
        "hasShoulder": c("has_shoulder"),
        "isSeparated": c("is_separated"),
        "hasTrafficCalming": c("has_traffic_calming"),
        "featureType": F.lit("edge"),
    }
    out = rows.select("id", _feature(c("geometry"), _json(properties)).alias("feature"))
    if nodes is not None:
        own = _json({"id": c("id"), "osmId": c("osm_id"), "featureType": F.lit("node")})
        out = out.unionByName(nodes.select("id", _feature(F.struct("lat", "lng"), own, "Point").alias("feature")))
    return out


def corridor_features(
    corridors: DataFrame, scores: DataFrame | None = None, types: tuple[str, ...] | None = None, min_length_m: float | None = None, style: bool = True
) -> DataFrame:
    """``id, type, feature`` of corridors with a line, coloured by score within the 5th to 95th
    percentile of what is exported, or by type without ``scores(id, overall, ...)``. A column
    ``elevation_profile`` of ``corridors`` becomes a member where it has heights."""
    rows = corridors.where(F.size("geometry") >= 2)
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if min_length_m is not None:
        rows = rows.where(F.col("length_m") >= min_length_m)
    c = F.col
    plain = F.coalesce(lookup(TYPE_COLOURS, c("type")), F.lit(FALLBACK_COLOUR))
    names = ("overall", *DIMENSIONS)
    if scores is None:
        rows = rows.withColumns({f"_{n}": F.lit(None).cast("double") for n in names}).withColumn("_colour", plain)
    else:
        rows = rows.join(scores.select("id", *[F.col(n).alias(f"_{n}") for n in names]), "id", "left")
        span = score_range(rows.where("_overall is not null").select(c("_overall").alias("overall")))
        rows = rows.crossJoin(F.broadcast(span))  # one row
        scaled = F.when(c("p5").isNotNull(), clamp((c("_overall") - c("p5")) / (c("p95") - c("p5")))).otherwise(c("_overall"))
        rows = rows.withColumn("_colour", F.when(c("_overall").isNotNull(), score_colour(scaled)).otherwise(plain))
    required = {
        "id": c("id"),
        "featureType": F.lit("corridor"),
        "corridorType": c("type"),
        "name": c("name"),
        "oneWay": c("one_way"),
        "lengthMeters": _rounded("length_m"),
        "lengthKm": round_half_up(c("length_m") / 1000, 1),
        "roadClass": c("road_class"),
        "surface": c("surface"),
        "surfaceConfidence": _rounded("surface_confidence", 2),
        "bicycleInfraContinuity": _rounded("bicycle_infra_continuity", 2),
        "pedestrianPathContinuity": _rounded("pedestrian_path_continuity", 2),
        "separationContinuity": _rounded("separation_continuity", 2),
        "trafficCalmingContinuity": _rounded("traffic_calming_continuity", 2),
        "stopDensityPerKm": _rounded("stop_density", 2),
        "crossingDensityPerKm": _rounded("crossing_density", 2),
        "edgeCount": c("edge_count"),
        "isDestination": F.coalesce("is_destination", F.lit(False)),
    }
    high = c("elevation_gain").isNotNull()
    where_high = lambda name, digits: F.when(high, round_half_up(F.coalesce(F.col(name), F.lit(0.0)), digits))
    optional = {
        "speedLimit": c("average_speed_limit"),
        **{"score" + n.capitalize(): _rounded(f"_{n}", 3) for n in names},
        "elevationGain": where_high("elevation_gain", 0),
        "elevationLoss": where_high("elevation_loss", 0),
        "averageGrade": where_high("average_grade", 2),
        "maxGrade": where_high("max_grade", 2),
        "hillinessIndex": where_high("hilliness", 3),
    }
    if "elevation_profile" in corridors.columns:
        optional["elevationProfile"] = F.when(F.size("elevation_profile") > 0, F.transform("elevation_profile", lambda z: round_half_up(z).cast("long")))
    if style:
        optional |= {"stroke": c("_colour"), "stroke-width": F.coalesce(lookup(TYPE_WIDTHS, c("type")), F.lit(2.0)), "stroke-opacity": F.lit(0.85)}
    return rows.select("id", "type", _feature(c("geometry"), _json(required, optional)).alias("feature"))


def connector_features(connectors: DataFrame, style: bool = True) -> DataFrame:
    """``id, feature`` of ``connectors`` with a ``geometry`` of two points or more."""
    c = F.col
    properties = {
        "id": c("id"),
        "featureType": F.lit("connector"),
        "lengthMeters": _rounded("length_m"),
        "crossesMajorRoad": c("crosses_major"),
        "hasSignal": c("has_signal"),
        "hasStop": c("has_stop"),
        "crossingDifficulty": _rounded("difficulty", 2),
        "corridorIds": c("corridor_ids"),
    }
    if style:
        properties |= {"stroke": F.lit(CONNECTOR_COLOUR), "stroke-width": F.lit(1), "stroke-opacity": F.lit(0.4)}
    return connectors.where(F.size("geometry") >= 2).select("id", _feature(c("geometry"), _json(properties)).alias("feature"))


def network_features(
    network: Network, scores: DataFrame | None = None, types: tuple[str, ...] | None = None, min_length_m: float | None = None, connectors: bool = False
) -> DataFrame:
    """``id, feature`` of the corridors chosen and, if asked for, of all connectors."""
    out = corridor_features(network.corridors, scores, types, min_length_m).select("id", "feature")
    return out.unionByName(connector_features(network.connectors)) if connectors else out


def write_collections(features: DataFrame, path: str, by: str | None = None) -> None:
    """Features as lines of text files below ``path``, in a folder for each value of ``by``; a line is a
    feature, so that no collection has to fit into one task."""
    rows = features.select(F.col("feature").alias("value"), *([by] if by else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def by_type(features: DataFrame) -> DataFrame:
    """``type, n``: the features of each corridor type; ``write_collections(features, path, "type")`` writes them."""
    return features.groupBy("type").agg(F.count("*").alias("n"))


def collection(features: DataFrame) -> DataFrame:
    """One row: a whole collection as text, for exports that fit into one value."""
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}"))
    return features.agg(text.alias("collection"))


def directed_lines(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``route, geometry`` of ``parts(route, pos, edge_id)``: lines of edges end to end, each turned the way it is travelled.

    The first edge is entered at the end that it does not share with the second, as it is if both
    or none are shared; every other one where the one before it was left, as it is if it has no
    such end. Points that repeat within 1e-8 are dropped.
    """
    rows = parts.join(edges.select(F.col("id").alias("edge_id"), "from_node", "to_node", "geometry"), "edge_id")
    lists = rows.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "from_node", "to_node", "geometry"))).alias("e"))
    first, second = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    ends = F.array(second["from_node"], second["to_node"])
    back = F.coalesce(F.array_contains(ends, first["from_node"]) & ~F.array_contains(ends, first["to_node"]), F.lit(False))
    empty = F.expr("CAST(array() AS array<struct<lat:double,lng:double>>)")
    state = F.struct(F.when(back, first["to_node"]).otherwise(first["from_node"]).alias("at"), empty.alias("line"))

    def walk(s: Column, x: Column) -> Column:
        turned = (x["to_node"] == s["at"]) & (x["from_node"] != s["at"])
        line = appended(s["line"], F.when(turned, F.reverse(x["geometry"])).otherwise(x["geometry"]))
        return F.struct(F.when(turned, x["from_node"]).otherwise(x["to_node"]).alias("at"), line.alias("line"))

    return lists.select("route", F.aggregate("e", state, walk, lambda s: s["line"]).alias("geometry"))


def route_features(runs: DataFrame, corridors: DataFrame, stats: DataFrame | None = None, route_index: int = 0) -> DataFrame:
    """``request_id, segment, feature``: a line for each segment that has one, unpaved ones in a colour of
    their own, and with ``stats(request_id, score, ...)`` an invisible summary of each route (segment null)."""
    primary, c = route_index == 0, F.col
    usual, unpaved = ROUTE_COLOURS[primary]
    own = corridors.select(c("id").alias("entity_id"), "type", "name", c("surface").alias("paving"))
    paving = F.coalesce("paving", F.lit("unknown"))
    properties = {
        "routeIndex": F.lit(route_index),
        "isPrimary": F.lit(primary),
        "isSegment": F.lit(True),
        "surface": paving,
        "corridorName": c("name"),
        "corridorType": F.coalesce("type", F.lit("connector")),
        "stroke": F.when(paving == "unpaved", unpaved).otherwise(usual),
        "stroke-width": F.lit(4 if primary else 3),
        "stroke-opacity": F.lit(0.9 if primary else 0.6),
    }
    rows = runs.join(own, "entity_id", "left")
    out = rows.where(F.size("geometry") >= 2).select("request_id", c("segment").cast("int").alias("segment"), _feature(c("geometry"), _json(properties)).alias("feature"))
    if stats is None:
        return out
    empty = F.expr("CAST(array() AS array<struct<lat:double,lng:double>>)")
    whole = runs.groupBy("request_id").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list(F.struct("segment", "geometry"))).alias("lines"))
    whole = whole.select("request_id", "segments", F.aggregate("lines", empty, lambda s, x: appended(s, x["geometry"])).alias("geometry"))
    metres = lambda s: F.coalesce(F.try_element_at("m_by_surface", F.lit(s)), F.lit(0.0))
    score = round_half_up(c("score"), 3) if "score" in stats.columns else F.lit(None).cast("double")
    summary = {
        "routeIndex": F.lit(route_index),
        "isPrimary": F.lit(primary),
        "isSegment": F.lit(False),
        "score": score,
        "distanceMeters": _rounded("distance_m"),
        "distanceKm": round_half_up(c("distance_m") / 1000, 1),
        "totalStops": c("stops"),
        "flowScore": c("flow"),
        "segmentCount": c("segments"),
        "elevationGain": c("elevation_gain"),
        "elevationLoss": c("elevation_loss"),
        "surfacePaved": metres("paved"),
        "surfaceUnpaved": metres("unpaved"),
        "surfaceUnknown": metres("unknown"),
        "stroke": F.lit("#000000"),
        "stroke-width": F.lit(0),
        "stroke-opacity": F.lit(0),
    }
    rows = stats.join(whole, "request_id")
    return out.unionByName(rows.select("request_id", F.lit(None).cast("int").alias("segment"), _feature(c("geometry"), _json(summary)).alias("feature")))


def route_profile(parts: DataFrame) -> DataFrame:
    """``request_id, profile`` from ``parts(request_id, segment, profile, reversed)``: corridor profiles end to
    end, turned where travelled backwards, the first sample of every later one left out; null if none."""
    lists = parts.where("profile is not null").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("segment", "profile", "reversed"))).alias("p"))
    turned = F.transform("p", lambda x, i: F.struct(i.alias("i"), F.when(x["reversed"], F.reverse(x["profile"])).otherwise(x["profile"]).alias("z")))
    return lists.select("request_id", F.flatten(F.transform(turned, lambda x: F.when(x["i"] == 0, x["z"]).otherwise(F.slice(x["z"], 2, F.greatest(F.size(x["z"]), F.lit(1)))))).alias("profile"))
