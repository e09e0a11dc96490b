"""Street graph from map elements: ways split at shared nodes into directed edges.

``osm_nodes(seq, id, lat, lon, tags)`` and ``osm_ways(seq, id, refs, tags)`` give ``nodes`` and
``edges``. References to nodes that do not exist are dropped; of nodes with the same id the one
of the largest ``seq`` counts. A way is cut at every inner point that ways refer to more than
once. ``seq`` of an edge is its place in the order (way, segment, forward before reverse), on
which later operators that depend on order rely.

Shuffles: the references go to the nodes once (by node id) and come back once (by way);
everything from there to the edges runs in that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import geo, tags as T
from trailweave.functions.tables import ROAD_HIGHWAYS, TRAIL_HIGHWAYS
from trailweave.operators.joins import shuffled

EDGE_FLAGS = ("has_bicycle_infra", "has_pedestrian_path", "has_shoulder", "is_separated", "has_traffic_calming")


@dataclass(frozen=True)
class Graph:
    """``nodes`` and directed ``edges`` of a street graph."""

    nodes: DataFrame
    edges: DataFrame


def latest_nodes(osm_nodes: DataFrame) -> DataFrame:
    """One row an id, that of the largest ``seq``."""
    return (
        osm_nodes.groupBy("id")
        .agg(F.max_by(F.struct("lat", "lon", "tags"), "seq").alias("n"))
        .select("id", F.col("n.lat").alias("lat"), F.col("n.lon").alias("lon"), F.col("n.tags").alias("tags"))
    )


def relevant_ways(osm_ways: DataFrame) -> DataFrame:
    return osm_ways.where(T.is_relevant(F.col("tags")))


def referenced_nodes(osm_nodes: DataFrame, osm_ways: DataFrame) -> DataFrame:
    """Nodes that a way refers to."""
    refs = osm_ways.select(F.explode("refs").alias("id")).distinct()
    return osm_nodes.join(shuffled(refs), "id", "left_semi")


def node_references(osm_ways: DataFrame) -> DataFrame:
    """``node_id, refs``: how often ways refer to a node, repetitions in a way included."""
    return osm_ways.select(F.explode("refs").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("refs"))


def _among(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def implicit_crossings(osm_ways: DataFrame) -> DataFrame:
    """``node_id`` of the nodes that a trail and a road share."""
    highway = T.tag(F.col("tags"), "highway")
    refs = osm_ways.select(F.explode("refs").alias("node_id"), _among(highway, TRAIL_HIGHWAYS).alias("t"), _among(highway, ROAD_HIGHWAYS).alias("r"))
    return refs.groupBy("node_id").agg(F.bool_or("t").alias("t"), F.bool_or("r").alias("r")).where("t and r").select("node_id")


def resolved_points(osm_nodes: DataFrame, osm_ways: DataFrame) -> DataFrame:
    """``way_seq, way_id, pos, node_id, lat, lng, highway, refs, meets``: the points of ways that exist.

    ``refs`` counts the references to the node, ``meets`` says that a trail and a road share it.
    """
    highway = T.tag(F.col("tags"), "highway")
    exploded = osm_ways.select(
        F.col("seq").alias("way_seq"),
        F.col("id").alias("way_id"),
        _among(highway, TRAIL_HIGHWAYS).alias("on_trail"),
        _among(highway, ROAD_HIGHWAYS).alias("on_road"),
        F.posexplode("refs").alias("ref_pos", "node_id"),
    )
    counts = exploded.groupBy("node_id").agg(
        F.count("*").alias("refs"), (F.bool_or("on_trail") & F.bool_or("on_road")).alias("meets")
    )
    nodes = latest_nodes(osm_nodes).select(F.col("id").alias("node_id"), "lat", F.col("lon").alias("lng"), T.tag(F.col("tags"), "highway").alias("highway"))
    known = counts.join(shuffled(nodes), "node_id")
    order = Window.partitionBy("way_id", "way_seq").orderBy("ref_pos")
    return (
        exploded.select("way_seq", "way_id", "ref_pos", "node_id", "on_trail")
        .join(shuffled(known), "node_id")
        .withColumn("pos", F.row_number().over(order) - 1)
        .drop("ref_pos")
    )


def way_segments(points: DataFrame) -> DataFrame:
    """``way_seq, way_id, start_pos, points``: the pieces of each way between its cuts, in order.

    A cut point ends one piece and begins the next, so its row is used for both.
    """
    by_way = Window.partitionBy("way_id", "way_seq")
    order = by_way.orderBy("pos")
    sized = points.withColumn("n", F.count("*").over(by_way)).where("n >= 2")
    cut = (F.col("pos") == 0) | ((F.col("pos") < F.col("n") - 1) & (F.col("refs") > 1))
    last_cut = F.last(F.when(cut, F.col("pos")), ignorenulls=True)
    marked = sized.withColumn("begins", last_cut.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "ends", last_cut.over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    place = F.when((F.col("pos") > 0) & (F.col("begins") == F.col("pos")), F.array("ends", "begins")).otherwise(F.array("begins"))
    row = F.struct("pos", "node_id", "lat", "lng", "highway", "meets")
    return (
        marked.select("way_seq", "way_id", F.explode(place).alias("start_pos"), row.alias("p"))
        .groupBy("way_id", "way_seq", "start_pos")
        .agg(F.array_sort(F.collect_list("p")).alias("points"))
        .where(F.size("points") >= 2)
    )


def build_graph(osm_nodes: DataFrame, osm_ways: DataFrame) -> Graph:
    """Directed edges with their attributes, and the nodes at their ends with flags."""
    points = resolved_points(osm_nodes, osm_ways)
    tags = F.col("tags")
    klass = T.road_class(tags)
    surface, confidence = T.surface(tags, F.col("road_class"))
    ways = (
        osm_ways.select("seq", "id", "tags", klass.alias("road_class"))
        .select(
            F.col("seq").alias("way_seq"),
            F.col("id").alias("way_id"),
            "road_class",
            surface.alias("surface"),
            confidence.alias("surface_confidence"),
            F.lit(False).alias("surface_conflict"),
            *[v.alias(k) for k, v in T.infrastructure(tags).items()],
            T.one_way(tags).alias("one_way"),
            T.reversed_one_way(tags).alias("reversed"),
            T.speed_limit(tags).alias("speed_limit"),
            T.lanes(tags).alias("lanes"),
            T.name(tags).alias("name"),
            T.scenic(tags).alias("scenic"),
            _among(T.tag(tags, "highway"), TRAIL_HIGHWAYS).alias("on_trail"),
        )
    )
    order = Window.partitionBy("way_id", "way_seq").orderBy("start_pos")
    segments = way_segments(points).withColumn("segment", F.row_number().over(order) - 1).join(shuffled(ways), ["way_id", "way_seq"])

    def counted(test) -> Column:
        return F.size(F.filter("points", test)).cast("int")

    is_ = lambda p, value: F.coalesce(p["highway"] == value, F.lit(False))
    last = F.size("points") - 1
    first_pos, last_pos = F.col("points")[0]["pos"], F.element_at("points", -1)["pos"]
    line = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    whole = segments.select(
        "*",
        line.alias("line"),
        counted(lambda p: is_(p, "stop")).alias("stop_sign_count"),
        counted(lambda p: is_(p, "traffic_signals")).alias("traffic_signal_count"),
        F.when(
            F.col("on_trail"),
            counted(
                lambda p: is_(p, "crossing")
                | (~is_(p, "stop") & ~is_(p, "traffic_signals") & p["meets"] & (p["pos"] != first_pos) & (p["pos"] != last_pos))
            ),
        )
        .otherwise(F.lit(0))
        .alias("road_crossing_count"),
    ).withColumn("length_m", geo.path_length(F.col("line")))
    a, b = F.col("points")[0]["node_id"].cast("string"), F.element_at("points", -1)["node_id"].cast("string")
    stem = F.concat(F.col("way_id").cast("string"), F.lit(":"), F.col("start_pos").cast("string"))

    def direction(edge_id: Column, turned: Column, side: int) -> Column:
        return F.struct(
            edge_id.alias("id"),
            F.when(turned, b).otherwise(a).alias("from_node"),
            F.when(turned, a).otherwise(b).alias("to_node"),
            F.when(turned, F.reverse("line")).otherwise(F.col("line")).alias("geometry"),
            F.lit(side).alias("side"),
        )

    both = F.array(direction(F.concat(stem, F.lit(":f")), F.lit(False), 0), direction(F.concat(stem, F.lit(":r")), F.lit(True), 1))
    edges = whole.withColumn("e", F.explode(F.when(F.col("one_way"), F.array(direction(stem, F.col("reversed"), 0))).otherwise(both))).select(
        (F.col("way_seq") * 2_000_000 + F.col("segment") * 2 + F.col("e.side")).cast("long").alias("seq"),
        F.col("e.id").alias("id"),
        F.col("e.from_node").alias("from_node"),
        F.col("e.to_node").alias("to_node"),
        F.col("way_id").cast("string").alias("osm_way_id"),
        F.col("e.geometry").alias("geometry"),
        "road_class",
        "surface",
        "surface_confidence",
        "surface_conflict",
        *EDGE_FLAGS,
        "one_way",
        "length_m",
        "lanes",
        "speed_limit",
        "name",
        "stop_sign_count",
        "traffic_signal_count",
        "road_crossing_count",
        "scenic",
        F.lit(None).cast("double").alias("elevation_gain"),
        F.lit(None).cast("double").alias("elevation_loss"),
        F.lit(None).cast("double").alias("average_grade"),
        F.lit(None).cast("double").alias("max_grade"),
    )
    ends = segments.select(
        "way_seq", "segment", "on_trail", F.posexplode(F.array(F.col("points")[0], F.get("points", last))).alias("side", "p")
    ).select(
        F.col("p.node_id").alias("node"),
        F.struct("way_seq", "segment", "side").alias("at"),
        F.struct(
            F.col("p.lat").alias("lat"),
            F.col("p.lng").alias("lng"),
            F.coalesce(F.col("p.highway") == "stop", F.lit(False)).alias("has_stop"),
            F.coalesce(F.col("p.highway") == "traffic_signals", F.lit(False)).alias("has_signal"),
            (F.coalesce(F.col("p.highway") == "crossing", F.lit(False)) | (F.col("on_trail") & F.col("p.meets"))).alias("is_crossing"),
        ).alias("v"),
    )
    # the first way that touches a node decides its flags
    nodes = ends.groupBy("node").agg(F.min_by("v", "at").alias("v")).select(F.col("node").cast("string").alias("id"), F.col("node").alias("osm_id"), "v.*")
    return Graph(nodes, edges)


def build_stats(graph: Graph, osm_ways: DataFrame) -> DataFrame:
    """One row: nodes, directed edges, undirected length, ways, one-way edges, two-way pairs."""
    edges = graph.edges.agg(
        F.count("*").alias("edges"),
        F.sum(F.when(~F.col("id").endswith(":r"), F.col("length_m"))).alias("length_m"),
        F.count_if("one_way").alias("one_way_edges"),
        F.count_if(F.col("id").endswith(":f")).alias("two_way_pairs"),
    )
    return graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(edges).crossJoin(osm_ways.agg(F.count("*").alias("ways")))  # one row each


def surface_stats(edges: DataFrame) -> DataFrame:
    """One row: edges of high, medium and low confidence, conflicts, and edges by surface."""
    c = F.col("surface_confidence")
    return edges.agg(
        F.count_if(c > 0.7).alias("high"),
        F.count_if((c > 0.4) & (c <= 0.7)).alias("medium"),
        F.count_if(c <= 0.4).alias("low"),
        F.count_if("surface_conflict").alias("conflicts"),
        *[F.count_if(F.col("surface") == s).alias(s) for s in ("paved", "unpaved", "unknown")],
    )


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: the box that holds all nodes."""
    return nodes.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))


def coverage(edges: DataFrame) -> DataFrame:
    """``attribute, n, share, km, km_share``: how many directed edges have an attribute."""
    c = F.col("surface_confidence")
    tests = {
        "surface known": F.col("surface") != "unknown",
        "surface high confidence": c > 0.7,
        "surface medium confidence": (c > 0.4) & (c <= 0.7),
        "surface conflict": F.col("surface_conflict"),
        "speed limit": F.col("speed_limit").isNotNull(),
        "lanes": F.col("lanes").isNotNull(),
        "name": F.nullif(F.col("name"), F.lit("")).isNotNull(),
        "bicycle infrastructure": F.col("has_bicycle_infra"),
        "separated": F.col("is_separated"),
        "traffic calming": F.col("has_traffic_calming"),
        "stop signs": F.col("stop_sign_count") > 0,
        "traffic signals": F.col("traffic_signal_count") > 0,
        "road crossings": F.col("road_crossing_count") > 0,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("attribute"), F.coalesce(v, F.lit(False)).alias("has")) for k, v in tests.items()])
    # thirteen flags a row are summed where the row is read; a handful of rows move
    flat = edges.select("length_m", F.explode(rows).alias("r")).groupBy("r.attribute").agg(
        F.count_if("r.has").alias("n"),
        F.count("*").alias("all_n"),
        F.sum(F.when(F.col("r.has"), F.col("length_m")).otherwise(0.0)).alias("m"),
        F.sum("length_m").alias("all_m"),
    )
    return flat.select(
        "attribute",
        "n",
        (F.col("n") / F.col("all_n")).alias("share"),
        (F.col("m") / 1000).alias("km"),
        F.when(F.col("all_m") > 0, F.col("m") / F.col("all_m")).otherwise(F.lit(0.0)).alias("km_share"),
    )


def distribution(edges: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, km, share``: edges and kilometres by ``keys``, the most edges first."""
    by = edges.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum("length_m") / 1000).alias("km"))
    total = edges.agg(F.count("*").alias("all_n"))
    return by.crossJoin(F.broadcast(total)).select(*keys, "n", "km", (F.col("n") / F.col("all_n")).alias("share")).orderBy(F.desc("n"), *keys)
