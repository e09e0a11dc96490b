"""All queries of the engine's own operators, by name, with their SQL where there is one.

Names begin with the operator they show. Sums of metres and other derived doubles are rounded
on both sides, as the order of summation differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import geo, scoring, tags as T, tiles
from trailweave.functions.numbers import round_half_up
from trailweave.operators import chains, corridors, elevation, export, fusion, location, matching, ranks, reports, search, street_graph as sg
from trailweave.operators.iterate import discard, scratch_path, settled
from trailweave.operators.joins import shuffled
from trailweave.operators.lines import simplified
from trailweave.functions.tables import RELEVANT_HIGHWAYS
from trailweave.plans import derived as D
from trailweave.sources import ingest, surface as S
from trailweave.streaming.observations import ObservationStream

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
#: Files of a micro-batch where a query streams a table.
STREAM_FILES = 2


def query(sql: str | None = None, graph: bool = False, observed: bool = False):
    """Register a function under its name; ``graph`` and ``observed`` put the derived tables before the SQL."""

    def add(f: Query) -> Query:
        text = sql
        if text and observed:
            text = D.GRAPH_SQL + "," + D.OBSERVATIONS_SQL + text
        elif text and graph:
            text = D.GRAPH_SQL + " " + text
        _FOUND[f.__name__] = f, text
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _FOUND.items() if v[1]}


def _graph(spark: SparkSession, d: str) -> sg.Graph:
    return sg.build_graph(D.osm_nodes(spark, d), D.osm_ways(spark, d))


def _settled_graph(spark: SparkSession, d: str) -> sg.Graph:
    """The graph as two tables, for queries that read it more than once."""
    g = _graph(spark, d)
    return sg.Graph(settled(g.nodes, "nodes"), settled(g.edges, "edges"))


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# Tags of ways.


_TAGGED = (*RELEVANT_HIGHWAYS, "construction", "proposed", "corridor", "raceway", "")


@query(
    f"""SELECT p_partkey AS way_id, ([{', '.join(f"'{h}'" for h in _TAGGED)}])[CAST(p_partkey % {len(_TAGGED)} AS INT) + 1]
 IN ({', '.join(f"'{h}'" for h in RELEVANT_HIGHWAYS)}) AS relevant FROM part"""
)
def prj_01_relevant_ways(spark, d):
    highway = F.element_at(F.array(*map(F.lit, _TAGGED)), (F.col("p_partkey") % len(_TAGGED) + 1).cast("int"))
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("way_id"), F.create_map(F.lit("highway"), highway).alias("tags"))
    return rows.select("way_id", T.is_relevant(F.col("tags")).alias("relevant"))


@query(D.GRAPH_SQL + " SELECT road_class, count(*) AS ways FROM tagged GROUP BY 1")
def prj_03_road_class(spark, d):
    return D.osm_ways(spark, d).groupBy(T.road_class(F.col("tags")).alias("road_class")).agg(F.count("*").alias("ways"))


@query(D.GRAPH_SQL + " SELECT way_id, surface, surface_confidence FROM tagged")
def prj_04_surface(spark, d):
    surface, confidence = T.surface(F.col("tags"), T.road_class(F.col("tags")))
    return D.osm_ways(spark, d).select(F.col("id").alias("way_id"), surface.alias("surface"), confidence.alias("surface_confidence"))


@query(D.GRAPH_SQL + " SELECT way_id, has_bicycle_infra, has_pedestrian_path, has_shoulder, is_separated, has_traffic_calming FROM tagged")
def prj_05_infrastructure(spark, d):
    return D.osm_ways(spark, d).select(F.col("id").alias("way_id"), *[v.alias(k) for k, v in T.infrastructure(F.col("tags")).items()])


@query(D.GRAPH_SQL + " SELECT way_id, one_way, reversed FROM tagged")
def prj_06_one_way(spark, d):
    t = F.col("tags")
    return D.osm_ways(spark, d).select(F.col("id").alias("way_id"), T.one_way(t).alias("one_way"), T.reversed_one_way(t).alias("reversed"))


@query(D.GRAPH_SQL + " SELECT way_id, speed_limit FROM tagged")
def prj_08_speed_limit(spark, d):
    return D.osm_ways(spark, d).select(F.col("id").alias("way_id"), T.speed_limit(F.col("tags")).alias("speed_limit"))


@query(D.GRAPH_SQL + " SELECT way_id, CAST(lanes AS BIGINT) AS lanes, name, scenic FROM tagged")
def prj_09_lanes_name_scenic(spark, d):
    t = F.col("tags")
    return D.osm_ways(spark, d).select(
        F.col("id").alias("way_id"), T.lanes(t).cast("long").alias("lanes"), T.name(t).alias("name"), T.scenic(t).alias("scenic")
    )


@query("SELECT id, CASE WHEN id LIKE '%:f' THEN replace(id, ':f', ':r') WHEN id LIKE '%:r' THEN replace(id, ':r', ':f') END AS twin FROM edges0", graph=True)
def prj_13_counterpart(spark, d):
    return _graph(spark, d).edges.select("id", T.counterpart(F.col("id")).alias("twin"))


# Geometry.

_PAIR = "FROM nodes0 a JOIN nodes0 b ON b.id = a.id + 65"


def _pairs(spark, d) -> DataFrame:
    n = D.osm_nodes(spark, d).select("id", "lat", F.col("lon").alias("lng"))
    b = n.select((F.col("id") - 65).alias("id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return n.join(shuffled(b), "id")


@query(
    f"""WITH {D.NODES_SQL} SELECT a.id, round(2 * 6371000e0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) +
 cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2))), 6) AS metres {_PAIR}"""
)
def geo_01_haversine(spark, d):
    c = [F.col(x) for x in ("lat", "lng", "lat2", "lng2")]
    return _pairs(spark, d).select("id", F.round(geo.haversine(*c), 6).alias("metres"))


@query(
    f"""WITH {D.NODES_SQL}, x AS (SELECT a.id, power(sin(radians(b.lat - a.lat) / 2), 2) +
 cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2) AS h {_PAIR})
 SELECT id, round(2 * 6371000e0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS metres FROM x"""
)
def geo_02_haversine_atan(spark, d):
    c = [F.col(x) for x in ("lat", "lng", "lat2", "lng2")]
    return _pairs(spark, d).select("id", F.round(geo.haversine_atan(*c), 6).alias("metres"))


@query(
    f"""WITH {D.NODES_SQL} SELECT a.id, round((degrees(atan2(sin(radians(b.lng - a.lng)) * cos(radians(b.lat)),
 cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)))) + 360) % 360, 6) AS bearing {_PAIR}"""
)
def geo_04_bearing(spark, d):
    c = [F.col(x) for x in ("lat", "lng", "lat2", "lng2")]
    return _pairs(spark, d).select("id", F.round(geo.bearing(*c), 6).alias("bearing"))


@query(
    f"""WITH {D.NODES_SQL} SELECT a.id, round(sqrt(power((a.lng - b.lng) * 111320e0 * cos(radians((a.lat + b.lat) / 2)), 2) +
 power((a.lat - b.lat) * 111320e0, 2)), 6) AS metres {_PAIR}"""
)
def geo_10_flat_distance(spark, d):
    c = [F.col(x) for x in ("lat", "lng", "lat2", "lng2")]
    return _pairs(spark, d).select("id", F.round(geo.flat_distance(*c), 6).alias("metres"))


@query(
    f"""WITH {D.NODES_SQL} SELECT id, round(lat - 2 / 111.32e0, 8) AS min_lat, round(lat + 2 / 111.32e0, 8) AS max_lat,
 round(lng - 2 / 111.32e0 / cos(radians(lat)), 8) AS min_lng, round(lng + 2 / 111.32e0 / cos(radians(lat)), 8) AS max_lng FROM nodes0"""
)
def geo_11_box_around(spark, d):
    n = D.osm_nodes(spark, d)
    box = geo.box_around(F.col("lat"), F.col("lon"), F.lit(2.0))
    return n.select("id", *[F.round(v, 8).alias(k) for k, v in box.items()])


@query(
    """SELECT round(min(lat), 8) AS min_lat, round(max(lat), 8) AS max_lat, round(min(lng), 8) AS min_lng, round(max(lng), 8) AS max_lng
 FROM nodes0 WHERE id IN (SELECT a FROM segments UNION SELECT b FROM segments)""",
    graph=True,
)
def geo_14_bounds(spark, d):
    b = sg.bounds(_graph(spark, d).nodes)
    return b.select(*[F.round(c, 8).alias(c) for c in b.columns])


@query(
    f"""WITH {D.NODES_SQL} SELECT id, CAST(floor(lng * 111320e0 * cos(radians(43e0)) / 100) AS BIGINT) AS cx, CAST(floor(lat * 111320e0 / 100) AS BIGINT) AS cy FROM nodes0"""
)
def geo_17_grid_cell(spark, d):
    x, y = geo.cell(F.col("lat"), F.col("lon"), F.lit(43.0))
    return D.osm_nodes(spark, d).select("id", x.alias("cx"), y.alias("cy"))


@query(
    """SELECT way_id, count(*) AS points, least(count(*), 2) AS kept, round(min_by(lat, pos), 7) AS first_lat, round(max_by(lng, pos), 7) AS last_lng FROM known GROUP BY 1""",
    graph=True,
)
def geo_15_simplified_ways(spark, d):
    """Ways along the grid are straight, so their ends are what is left."""
    points = sg.resolved_points(D.osm_nodes(spark, d), D.osm_ways(spark, d))
    lines = points.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lng"))).alias("p"))
    lines = lines.select("way_id", F.size("p").cast("long").alias("points"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("line"))
    kept = lines.withColumn("line", simplified(F.col("line"), 10.0))
    ends = F.round(F.col("line")[0]["lat"], 7).alias("first_lat"), F.round(F.element_at("line", -1)["lng"], 7).alias("last_lng")
    return kept.select("way_id", "points", F.size("line").cast("long").alias("kept"), *ends)


# Graph construction.


@query("SELECT node_id, count(*) AS refs FROM refs0 GROUP BY 1", graph=True)
def agg_01_node_refs(spark, d):
    return sg.node_references(D.osm_ways(spark, d))


@query("SELECT id, lat, lng FROM nodes0 WHERE id IN (SELECT node_id FROM refs0)", graph=True)
def join_02_referenced_nodes(spark, d):
    return sg.referenced_nodes(D.osm_nodes(spark, d), D.osm_ways(spark, d)).select("id", "lat", F.col("lon").alias("lng"))


@query("SELECT node_id FROM counted WHERE meets", graph=True)
def join_03_implicit_crossings(spark, d):
    return sg.implicit_crossings(D.osm_ways(spark, d))


@query("SELECT way_id, pos, node_id FROM known", graph=True)
def join_01_resolved_refs(spark, d):
    return sg.resolved_points(D.osm_nodes(spark, d), D.osm_ways(spark, d)).select("way_id", _long("pos"), "node_id")


@query("SELECT way_id, start_pos, stop - start_pos + 1 AS points FROM segments", graph=True)
def win_01_segments(spark, d):
    s = sg.way_segments(sg.resolved_points(D.osm_nodes(spark, d), D.osm_ways(spark, d)))
    return s.select("way_id", _long("start_pos"), F.size("points").cast("long").alias("points"))


@query(
    "SELECT id, CAST(from_node AS VARCHAR) AS from_node, CAST(to_node AS VARCHAR) AS to_node, round(length_m, 4) AS length_m, road_class, surface FROM edges0",
    graph=True,
)
def win_02_edges(spark, d):
    return _graph(spark, d).edges.select("id", "from_node", "to_node", F.round("length_m", 4).alias("length_m"), "road_class", "surface")


@query("SELECT id, stops AS stop_sign_count, signals AS traffic_signal_count, crossings AS road_crossing_count FROM edges0", graph=True)
def agg_02_control_counts(spark, d):
    return _graph(spark, d).edges.select("id", _long("stop_sign_count"), _long("traffic_signal_count"), _long("road_crossing_count"))


@query(
    """SELECT (SELECT count(*) FROM (SELECT a FROM segments UNION SELECT b FROM segments)) AS nodes, count(*) AS edges,
 round(sum(CASE WHEN id NOT LIKE '%:r' THEN length_m END), 2) AS length_m, count(*) FILTER (one_way) AS one_way_edges,
 count(*) FILTER (id LIKE '%:f') AS two_way_pairs, (SELECT count(*) FROM ways0) AS ways FROM edges0""",
    graph=True,
)
def agg_03_build_stats(spark, d):
    ways = D.osm_ways(spark, d)
    return sg.build_stats(_graph(spark, d), ways).withColumn("length_m", F.round("length_m", 2))


@query(
    """SELECT count(*) FILTER (surface_confidence > 0.7) AS high, count(*) FILTER (surface_confidence > 0.4 AND surface_confidence <= 0.7) AS medium,
 count(*) FILTER (surface_confidence <= 0.4) AS low, CAST(0 AS BIGINT) AS conflicts, count(*) FILTER (surface = 'paved') AS paved,
 count(*) FILTER (surface = 'unpaved') AS unpaved, count(*) FILTER (surface = 'unknown') AS unknown FROM edges0""",
    graph=True,
)
def agg_04_surface_stats(spark, d):
    return sg.surface_stats(_graph(spark, d).edges)


_COVER = {
    "surface known": "surface <> 'unknown'",
    "surface high confidence": "surface_confidence > 0.7",
    "surface medium confidence": "surface_confidence > 0.4 AND surface_confidence <= 0.7",
    "surface conflict": "false",
    "speed limit": "speed_limit IS NOT NULL",
    "lanes": "lanes IS NOT NULL",
    "name": "name IS NOT NULL AND name <> ''",
    "bicycle infrastructure": "has_bicycle_infra",
    "separated": "is_separated",
    "traffic calming": "has_traffic_calming",
    "stop signs": "stops > 0",
    "traffic signals": "signals > 0",
    "road crossings": "crossings > 0",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{k}' AS attribute, count(*) FILTER ({v}) AS n, round(count(*) FILTER ({v}) / count(*), 8) AS share,
 round(coalesce(sum(length_m) FILTER ({v}), 0) / 1000, 4) AS km, round(coalesce(sum(length_m) FILTER ({v}), 0) / sum(length_m), 8) AS km_share FROM edges0"""
        for k, v in _COVER.items()
    ),
    graph=True,
)
def agg_20_coverage(spark, d):
    c = sg.coverage(_graph(spark, d).edges)
    return c.select("attribute", "n", F.round("share", 8).alias("share"), F.round("km", 4).alias("km"), F.round("km_share", 8).alias("km_share"))


@query(
    """SELECT road_class, surface, count(*) AS n, round(sum(length_m) / 1000, 4) AS km, round(count(*) / (SELECT count(*) FROM edges0), 8) AS share
 FROM edges0 GROUP BY 1, 2""",
    graph=True,
)
def agg_21_distribution(spark, d):
    x = sg.distribution(_graph(spark, d).edges, "road_class", "surface")
    return x.select("road_class", "surface", "n", F.round("km", 4).alias("km"), F.round("share", 8).alias("share"))


@query(
    """SELECT road_class, round(list_sort(list(round(length_m, 4)))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INT) + 1], 4) AS p50
 FROM edges0 GROUP BY 1""",
    graph=True,
)
def agg_24_percentile(spark, d):
    e = _graph(spark, d).edges.select("road_class", F.round("length_m", 4).alias("m"))
    return ranks.at_fraction_by(e, ["road_class"], "m", 0.5, "p50")


# Observations.

_W = {
    "surface": "CASE source WHEN 'gravelmap' THEN 0.9e0 WHEN 'user-report' THEN 0.85e0 WHEN 'osm-tag' THEN 0.7e0 WHEN 'mapillary' THEN 0.65e0 WHEN 'osm-inferred' THEN 0.2e0 ELSE 0.5e0 END * confidence",
    "speed": "CASE source WHEN 'municipal-open-data' THEN 0.9e0 WHEN 'google-roads' THEN 0.85e0 WHEN 'osm-tag' THEN 0.8e0 WHEN 'mapillary' THEN 0.75e0 WHEN 'osm-inferred' THEN 0.15e0 ELSE 0.5e0 END * confidence",
    "bool": "CASE source WHEN 'municipal-open-data' THEN 0.9e0 WHEN 'osm-tag' THEN 0.7e0 WHEN 'mapillary' THEN 0.6e0 ELSE 0.5e0 END * confidence",
    "scenic": "CASE source WHEN 'user-report' THEN 0.85e0 WHEN 'osm-tag' THEN 0.7e0 ELSE 0.5e0 END * confidence",
}


def _matched(spark, d) -> DataFrame:
    e = _graph(spark, d).edges.select(F.col("id").alias("edge_id"), "osm_way_id")
    return D.observations(spark, d).join(shuffled(e), "osm_way_id")


@query(" SELECT seq, edge_id, attribute FROM matched", observed=True)
def join_07_way_match(spark, d):
    o = D.observations(spark, d).withColumnRenamed("seq", "obs_id")
    m = matching.way_edges(o, _graph(spark, d).edges).join(shuffled(o.select("obs_id", "attribute")), "obs_id")
    return m.select(F.col("obs_id").alias("seq"), "edge_id", "attribute")


@query(
    f""", v AS (SELECT edge_id, (['paved','unpaved','unknown'])[CAST(w % 3 AS INT) + 1] AS s, sum({_W['surface']}) AS w, count(*) AS n, min(seq) AS first
 FROM matched WHERE attribute = 'surface' GROUP BY 1, 2), t AS (SELECT edge_id, max(w) AS top, sum(w) AS total, sum(n) AS n FROM v GROUP BY 1)
 SELECT t.edge_id, (SELECT s FROM v WHERE v.edge_id = t.edge_id ORDER BY round(w, 9) DESC, first LIMIT 1) AS value,
 round(least(0.95e0, top / total * 0.5 + least(n / 3, 1) * 0.3 + top / 2 * 0.2), 6) AS confidence,
 (SELECT count(*) > 1 FROM v WHERE v.edge_id = t.edge_id AND w > top * 0.15) AS has_conflict, CAST(n AS BIGINT) AS n FROM t""",
    observed=True,
)
def agg_06_surface_fusion(spark, d):
    o = _matched(spark, d).where("attribute = 'surface'").withColumn("confidence", F.round("confidence", 6))
    f = fusion.fuse_votes(o)
    return f.select("edge_id", F.col("value_str").alias("value"), F.round("confidence", 6).alias("confidence"), "has_conflict", "n")


@query(
    f""", v AS (SELECT edge_id, 20e0 + w % 8 * 10 AS x, sum({_W['speed']}) AS w, count(*) AS n FROM matched WHERE attribute = 'speed-limit' GROUP BY 1, 2),
 r AS (SELECT *, sum(w) OVER (PARTITION BY edge_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY edge_id) AS total FROM v)
 SELECT edge_id, min(x) FILTER (upto + 1e-9 >= total / 2) AS value, round(least(0.95e0, least(sum(n) / 2, 1) * 0.4 + max(total) / sum(n) * 0.6), 6) AS confidence,
 max(x) - min(x) > 20 AS has_conflict, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""",
    observed=True,
)
def agg_07_speed_fusion(spark, d):
    f = fusion.fuse_median(_matched(spark, d).where("attribute = 'speed-limit'"))
    return f.select("edge_id", F.col("value_num").alias("value"), F.round("confidence", 6).alias("confidence"), "has_conflict", "n")


@query(
    f""", t AS (SELECT edge_id, sum(CASE WHEN w % 2 = 0 THEN {_W['bool']} ELSE 0 END) AS yes, sum(CASE WHEN w % 2 = 0 THEN 0 ELSE {_W['bool']} END) AS no, count(*) AS n
 FROM matched WHERE attribute = 'bicycle-infra' GROUP BY 1)
 SELECT edge_id, yes >= no AS value, round(least(0.95e0, greatest(yes, no) / (yes + no) * 0.5 + least(n / 2, 1) * 0.5), 6) AS confidence,
 greatest(yes, no) / (yes + no) < 0.7 AS has_conflict, n FROM t""",
    observed=True,
)
def agg_10_boolean_fusion(spark, d):
    f = fusion.fuse_flags(_matched(spark, d).where("attribute = 'bicycle-infra'"))
    return f.select("edge_id", F.col("value_bool").alias("value"), F.round("confidence", 6).alias("confidence"), "has_conflict", "n")


@query(
    f""" SELECT edge_id, round(sum({_W['scenic']} * (w % 11 / 10e0)) / sum({_W['scenic']}), 6) AS value,
 round(least(0.95e0, least(count(*) / 2, 1) * 0.4 + sum({_W['scenic']}) / count(*) * 0.6), 6) AS confidence, var_pop(w % 11 / 10e0) > 0.1 AS has_conflict, count(*) AS n
 FROM matched WHERE attribute = 'scenic' GROUP BY 1""",
    observed=True,
)
def agg_11_numeric_fusion(spark, d):
    f = fusion.fuse_mean(_matched(spark, d).where("attribute = 'scenic'"))
    return f.select("edge_id", F.round("value_num", 6).alias("value"), F.round("confidence", 6).alias("confidence"), "has_conflict", "n")


@query()
def agg_08_point_fusion(spark, d):
    return fusion.fuse_points(_matched(spark, d).where("attribute = 'traffic-signal'"))


@query(
    """ SELECT source, attribute, count(DISTINCT seq) AS observations, count(DISTINCT seq) FILTER (edge_id IS NOT NULL) AS matched, count(DISTINCT edge_id) AS edges
 FROM (SELECT o.seq, o.source, o.attribute, m.edge_id FROM obs0 o LEFT JOIN matched m USING (seq)) GROUP BY 1, 2""",
    observed=True,
)
def agg_14_enrichment_stats(spark, d):
    return fusion.enrichment_stats(D.observations(spark, d), _matched(spark, d))


@query(
    f""", v AS (SELECT edge_id, (['paved','unpaved','unknown'])[CAST(w % 3 AS INT) + 1] AS s, sum({_W['surface']}) AS w, count(*) AS n, min(seq) AS first
 FROM matched WHERE attribute = 'surface' GROUP BY 1, 2), t AS (SELECT edge_id, max(w) AS top, sum(w) AS total, sum(n) AS n FROM v GROUP BY 1),
 sur AS (SELECT t.edge_id, (SELECT s FROM v WHERE v.edge_id = t.edge_id ORDER BY round(w, 9) DESC, first LIMIT 1) AS value, least(0.95e0, top / total * 0.5 + least(n / 3, 1) * 0.3 + top / 2 * 0.2) AS confidence FROM t),
 sv AS (SELECT edge_id, 20e0 + w % 8 * 10 AS x, sum({_W['speed']}) AS w FROM matched WHERE attribute = 'speed-limit' GROUP BY 1, 2),
 sr AS (SELECT *, sum(w) OVER (PARTITION BY edge_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY edge_id) AS total FROM sv),
 spd AS (SELECT edge_id, min(x) FILTER (upto + 1e-9 >= total / 2) AS value FROM sr GROUP BY 1),
 boo AS (SELECT edge_id, sum(CASE WHEN w % 2 = 0 THEN {_W['bool']} ELSE 0 END) >= sum(CASE WHEN w % 2 = 0 THEN 0 ELSE {_W['bool']} END) AS value FROM matched WHERE attribute = 'bicycle-infra' GROUP BY 1),
 sce AS (SELECT edge_id, round(sum({_W['scenic']} * (w % 11 / 10e0)) / sum({_W['scenic']}), 9) AS value FROM matched WHERE attribute = 'scenic' GROUP BY 1),
 sig AS (SELECT DISTINCT edge_id FROM matched WHERE attribute = 'traffic-signal')
 SELECT e.id, coalesce(sur.value, e.surface) AS surface, round(coalesce(sur.confidence, e.surface_confidence), 6) AS surface_confidence, CASE WHEN spd.value > 0 THEN spd.value ELSE e.speed_limit END AS speed_limit,
 e.signals + (sig.edge_id IS NOT NULL)::INT AS traffic_signal_count, coalesce(boo.value, e.has_bicycle_infra) AS has_bicycle_infra, coalesce(sce.value > 0.5, e.scenic) AS scenic,
 nullif((sur.edge_id IS NOT NULL)::INT + (spd.edge_id IS NOT NULL)::INT + (boo.edge_id IS NOT NULL)::INT + (sce.edge_id IS NOT NULL)::INT + (sig.edge_id IS NOT NULL)::INT, 0)::BIGINT AS enriched
 FROM edges0 e LEFT JOIN sur ON sur.edge_id = e.id LEFT JOIN spd ON spd.edge_id = e.id LEFT JOIN boo ON boo.edge_id = e.id LEFT JOIN sce ON sce.edge_id = e.id LEFT JOIN sig ON sig.edge_id = e.id""",
    observed=True,
)
def gra_17_enriched_edges(spark, d):
    edges = _graph(spark, d).edges
    fused = fusion.fuse(_matched(spark, d).withColumn("confidence", F.round("confidence", 6))).withColumn("value_num", F.round("value_num", 9))
    out = fusion.write_back(edges, fused)
    known = F.when(F.col("enrichment").isNotNull(), F.size("enrichment")).cast("long").alias("enriched")
    return out.select("id", "surface", F.round("surface_confidence", 6).alias("surface_confidence"), "speed_limit", _long("traffic_signal_count"), "has_bicycle_infra", "scenic", known)


@query(
    f""", v AS (SELECT edge_id, (['paved','unpaved','unknown'])[CAST(w % 3 AS INT) + 1] AS s, sum({_W['surface']}) AS w, count(*) AS n, min(seq) AS first
 FROM matched WHERE attribute = 'surface' GROUP BY 1, 2), t AS (SELECT edge_id, max(w) AS top, sum(w) AS total, sum(n) AS n FROM v GROUP BY 1),
 b AS (SELECT edge_id, 20e0 + w % 8 * 10 AS x, sum({_W['speed']}) AS w, count(*) AS n FROM matched WHERE attribute = 'speed-limit' GROUP BY 1, 2),
 r AS (SELECT *, sum(w) OVER (PARTITION BY edge_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY edge_id) AS total FROM b),
 f AS (SELECT edge_id, sum(CASE WHEN w % 2 = 0 THEN {_W['bool']} ELSE 0 END) AS yes, sum(CASE WHEN w % 2 = 0 THEN 0 ELSE {_W['bool']} END) AS no, count(*) AS n
 FROM matched WHERE attribute = 'bicycle-infra' GROUP BY 1)
 SELECT t.edge_id, 'surface' AS attribute, (SELECT s FROM v WHERE v.edge_id = t.edge_id ORDER BY round(w, 9) DESC, first LIMIT 1) AS value_str, NULL::DOUBLE AS value_num, NULL::BOOLEAN AS value_bool,
 round(least(0.95e0, top / total * 0.5 + least(n / 3, 1) * 0.3 + top / 2 * 0.2), 6) AS confidence,
 (SELECT count(*) > 1 FROM v WHERE v.edge_id = t.edge_id AND w > top * 0.15) AS has_conflict, CAST(n AS BIGINT) AS n FROM t
 UNION ALL SELECT edge_id, 'speed-limit', NULL, min(x) FILTER (upto + 1e-9 >= total / 2), NULL, round(least(0.95e0, least(sum(n) / 2, 1) * 0.4 + max(total) / sum(n) * 0.6), 6),
 max(x) - min(x) > 20, CAST(sum(n) AS BIGINT) FROM r GROUP BY 1
 UNION ALL SELECT edge_id, 'bicycle-infra', NULL, NULL, yes >= no, round(least(0.95e0, greatest(yes, no) / (yes + no) * 0.5 + least(n / 2, 1) * 0.5), 6), greatest(yes, no) / (yes + no) < 0.7, n FROM f
 UNION ALL SELECT edge_id, 'scenic', NULL, round(sum({_W['scenic']} * (w % 11 / 10e0)) / sum({_W['scenic']}), 6), NULL,
 round(least(0.95e0, least(count(*) / 2, 1) * 0.4 + sum({_W['scenic']}) / count(*) * 0.6), 6), var_pop(w % 11 / 10e0) > 0.1, count(*) FROM matched WHERE attribute = 'scenic' GROUP BY 1
 UNION ALL SELECT edge_id, 'traffic-signal', NULL, NULL, NULL, NULL, false, count(*) FROM matched WHERE attribute = 'traffic-signal' GROUP BY 1""",
    observed=True,
)
def gra_17_stream(spark, d):
    """Observations of edges as a stream in batches; of signals, whose clusters SQL cannot follow, how many there are."""
    rows = settled(_matched(spark, d).withColumn("confidence", F.round("confidence", 6)), "observed")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(rows._scratch)
    stream = ObservationStream(scratch_path(spark, "stream"))
    stream.start(source, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    discard(rows)
    fused, spots = stream.current(spark), F.col("attribute") == "traffic-signal"
    number = F.when(~spots, F.round("value_num", 6)).alias("value_num")
    return fused.select("edge_id", "attribute", "value_str", number, "value_bool", F.when(~spots, F.round("confidence", 6)).alias("confidence"), "has_conflict", "n")


_CELLS = """, v AS (SELECT DISTINCT e.id AS edge_id, e.way_id, CAST(floor(k.lng * 111320e0 * cos(radians(43e0)) / 100) AS BIGINT) AS cx,
 CAST(floor(k.lat * 111320e0 / 100) AS BIGINT) AS cy FROM edges0 e JOIN known k ON k.way_id = e.way_id AND k.pos BETWEEN e.start_pos AND e.stop),
 p AS (SELECT *, CAST(floor(v_lng * 111320e0 * cos(radians(43e0)) / 100) AS BIGINT) AS px, CAST(floor(v_lat * 111320e0 / 100) AS BIGINT) AS py FROM obs0 WHERE attribute = 'traffic-signal'),
 g AS (SELECT e.id AS edge_id, k.lat AS y1, k.lng AS x1, l.lat AS y2, l.lng AS x2 FROM edges0 e JOIN known k ON k.way_id = e.way_id AND k.pos BETWEEN e.start_pos AND e.stop - 1
  JOIN known l ON l.way_id = k.way_id AND l.pos = k.pos + 1),
 c AS (SELECT DISTINCT p.seq, p.v_lat, p.v_lng, v.edge_id FROM p JOIN v ON v.cx BETWEEN p.px - 1 AND p.px + 1 AND v.cy BETWEEN p.py - 1 AND p.py + 1),
 m AS (SELECT c.seq, c.edge_id, (c.v_lng - x1) * 111320e0 * cos(radians(43e0)) AS ax, (c.v_lat - y1) * 111320e0 AS ay, (x2 - x1) * 111320e0 * cos(radians(43e0)) AS dx, (y2 - y1) * 111320e0 AS dy
  FROM c JOIN g USING (edge_id)),
 s AS (SELECT *, greatest(0e0, least(1e0, (ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM m),
 near AS (SELECT seq, edge_id, min(sqrt(power(ax - t * dx, 2) + power(ay - t * dy, 2))) AS dist FROM s GROUP BY 1, 2)"""


def _spots(spark, d) -> DataFrame:
    o = D.observations(spark, d).where("attribute = 'traffic-signal'")
    return o.select(F.col("seq").alias("obs_id"), F.col("v_lat").alias("lat"), F.col("v_lng").alias("lng"))


@query(
    _CELLS + """, o AS (SELECT near.*, row_number() OVER (PARTITION BY seq ORDER BY round(dist, 6), way_id, start_pos, d) AS k FROM near JOIN edges0 e ON e.id = edge_id WHERE dist < 50)
 SELECT seq AS obs_id, edge_id, round(dist, 4) AS distance FROM o WHERE k = 1""",
    observed=True,
)
def join_08_nearest_edge(spark, d):
    return matching.nearest_edges(_spots(spark, d), _graph(spark, d).edges, 43.0).select("obs_id", "edge_id", F.round("distance", 4).alias("distance"))


@query(
    _CELLS.replace("FROM obs0 WHERE", "FROM (SELECT * REPLACE (v_lat + i * 0.0004e0 AS v_lat, v_lng + i * 0.0005e0 AS v_lng) FROM obs0, (SELECT unnest(range(0, 4)) AS i)) WHERE")
    .replace("SELECT seq, edge_id, min(sqrt", "SELECT seq, edge_id, v_lat, min(sqrt")
    .replace("SELECT c.seq, c.edge_id, (c.v_lng", "SELECT c.seq, c.edge_id, c.v_lat, (c.v_lng")
    .replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
    + " SELECT DISTINCT seq AS obs_id, edge_id FROM near WHERE dist < 50",
    observed=True,
)
def join_09_line_match(spark, d):
    line = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.col("lat") + i * F.lit(0.0004)).alias("lat"), (F.col("lng") + i * F.lit(0.0005)).alias("lng")))
    return matching.line_edges(_spots(spark, d).select("obs_id", line.alias("geometry")), _graph(spark, d).edges, 43.0)


# Likeness and chains.

_ENDS = """, q AS (SELECT *, CASE WHEN (one_way AND reversed) OR d = 'r' THEN -step ELSE step END AS go FROM edges0),
 z AS (SELECT q.*, to_node - go AS p1, to_node AS p2, from_node AS f1, from_node + go AS f2, step = 64 AS north, go > 0 AS ahead FROM q),
 pair AS (SELECT a.id AS a_id, b.id AS b_id, a.road_class AS c1, b.road_class AS c2, a.surface AS s1, b.surface AS s2, a.name AS n1, b.name AS n2, a.speed_limit AS v1, b.speed_limit AS v2,
 (a.has_bicycle_infra = b.has_bicycle_infra)::INT + (a.has_pedestrian_path = b.has_pedestrian_path)::INT + 1 + (a.is_separated = b.is_separated)::INT + (a.has_traffic_calming = b.has_traffic_calming)::INT AS same
 FROM z a JOIN z b ON a.to_node = b.from_node AND a.id <> b.id AND a.north = b.north AND a.ahead = b.ahead),
 grp AS (SELECT unnest(['motorway','trunk','primary','secondary','tertiary','residential','service','unclassified','cycleway','path','footway','track']) AS c,
  unnest([0,1,2,3,4,5,5,5,6,7,7,8]) AS g, unnest([0,1,2,3,4,5,6,6,7,8,8,9]) AS r),
 scored AS (SELECT a_id, b_id, CASE WHEN abs(v1 - v2) > 15 OR x.g <> y.g THEN 0 ELSE
  0.42e0 * CASE WHEN c1 = c2 THEN 1 ELSE greatest(0, 1 - 0.3e0 * abs(x.r - y.r)) END + 0.23e0 * CASE WHEN s1 = s2 THEN 1 ELSE 0.5e0 END + 0.18e0 * same / 5e0
  + 0.10e0 * CASE WHEN n1 IS NOT DISTINCT FROM n2 THEN 1 ELSE 0.5e0 END + 0.07e0 END AS score
 FROM pair JOIN grp x ON x.c = c1 JOIN grp y ON y.c = c2)"""


@query(_ENDS + " SELECT a_id, b_id, round(score, 6) AS score FROM scored WHERE score >= 0.5", observed=True)
def join_04_continuations(spark, d):
    e = _graph(spark, d).edges
    p = chains.continuations(e)
    ids = e.select("seq", "id")
    return p.join(shuffled(ids.select(F.col("seq").alias("a"), F.col("id").alias("a_id"))), "a").join(shuffled(ids.select(F.col("seq").alias("b"), F.col("id").alias("b_id"))), "b").select(
        "a_id", "b_id", F.round("score", 6).alias("score")
    )


@query()
def gra_02_chains(spark, d):
    return chains.build_chains(_graph(spark, d).edges).select("chain_id", _long("pos"), "edge_id")


@query()
def gra_03_core_degrees(spark, d):
    e = settled(_graph(spark, d).edges, "edges")
    return chains.core_degrees(chains.build_chains(e), e)


_WAY = "SELECT *, start_pos AS pos FROM edges0 WHERE d = 'f'"


#: Ways as corridors: sums, ends and types, as the roll-up gives them.
_ROLLED = f""", w AS ({_WAY}), deg AS (SELECT from_node AS node, count(*) AS n FROM edges0 GROUP BY 1 HAVING count(*) > 2),
 busy AS (SELECT way_id, count(DISTINCT node) AS nb FROM (SELECT way_id, unnest([from_node, to_node]) AS node FROM w) JOIN deg USING (node) GROUP BY 1),
 r AS (SELECT way_id, sum(length_m) AS m, count(*) AS n_edges, any_value(road_class) AS c, any_value(surface) AS s, any_value(surface_confidence) AS k,
  any_value(has_bicycle_infra)::INT::DOUBLE AS bi, any_value(has_pedestrian_path)::INT::DOUBLE AS pe, any_value(is_separated)::INT::DOUBLE AS se, any_value(has_traffic_calming)::INT::DOUBLE AS ca,
  any_value(scenic)::INT::DOUBLE AS sc, any_value(speed_limit) AS v, sum(stops + signals + crossings) / (sum(length_m) / 1000) AS sd, coalesce(any_value(nb), 0) / (sum(length_m) / 1000) AS cd,
  any_value(one_way) AS one_way, min_by(from_node, pos) AS start_node, max_by(to_node, pos) AS end_node, any_value(name) AS name
  FROM w LEFT JOIN busy USING (way_id) GROUP BY 1),
 rolled AS (SELECT *, CASE WHEN c IN ('cycleway', 'path') AND se > 0.7 THEN 'trail' WHEN c IN ('footway', 'path') THEN 'path' WHEN c IN ('primary', 'trunk', 'motorway') THEN 'arterial'
  WHEN c IN ('secondary', 'tertiary') THEN 'collector' WHEN c IN ('residential', 'unclassified', 'service') AND coalesce(v, 0) <= 40
  THEN CASE WHEN cd < 4 AND sd < 2 AND pe < 0.3 AND ca < 0.3 THEN 'rural-road' ELSE 'neighborhood' END ELSE 'mixed' END AS type FROM r)"""


def _parameter_rows(simple: bool) -> str:
    """A row of scoring parameters for each activity."""
    rows = []
    for a in scoring.ACTIVITIES:
        p = scoring.simple_defaults(a) if simple else scoring.defaults(a)
        values = [*p["weights"].values(), p["flow"]["numerator"], *p["safety"].values(), *p["surface"].values(), *p["character"].values(), p["crossing_decay"]]
        rows.append(f"('{a}', {', '.join(f'{float(v)}::DOUBLE' for v in values)})")
    names = [f"w{k}" for k in range(6)] + ["num"] + [f"f{k}" for k in range(6)] + ["sp", "su", "sq"] + [f"h{k}" for k in range(7)] + ["decay"]
    return f"par AS (SELECT * FROM (VALUES {', '.join(rows)}) p(activity, {', '.join(names)}))"


_SPEED = "CASE WHEN v IS NULL THEN 0.5 WHEN v < 30.001 THEN 1 WHEN v < 40.001 THEN 0.8 WHEN v < 50.001 THEN 0.6 WHEN v < 60.001 THEN 0.3 ELSE 0.1 END"
_CLASS_SAFE = """CASE WHEN c IN ('cycleway', 'path', 'footway') THEN 1 WHEN c IN ('residential', 'service') THEN 0.8 WHEN c IN ('unclassified', 'track') THEN 0.7
 WHEN c = 'tertiary' THEN 0.5 WHEN c = 'secondary' THEN 0.3 WHEN c = 'primary' THEN 0.15 ELSE 0 END"""
_FLOW_SQL = "0.6e0 * least(1, ln(1 + m / 300) / ln(1 + num / 300)) + 0.4e0 * exp(-0.2e0 * sd)"
_SAFETY_SQL = f"f0 * {_CLASS_SAFE} + f1 * {_SPEED} + f2 * bi + f3 * pe + f4 * se + f5 * ca"


def _scored(simple: bool = False) -> str:
    """All scores of ways as corridors, by activity."""
    return _ROLLED + f""", {_parameter_rows(simple)}, dims AS (SELECT way_id, activity, m, w0, w1, w2, w3, w4, w5, {_FLOW_SQL} AS flow, {_SAFETY_SQL} AS safety,
 CASE s WHEN 'paved' THEN sp WHEN 'unpaved' THEN su ELSE sq END * (0.5e0 + 0.5e0 * k) AS surface,
 CASE type WHEN 'collector' THEN h0 WHEN 'rural-road' THEN h1 WHEN 'mixed' THEN h2 WHEN 'neighborhood' THEN h3 WHEN 'arterial' THEN h4 WHEN 'trail' THEN h5 ELSE h6 END
 * CASE WHEN decay > 0 THEN exp(-decay * cd) ELSE 1 END AS "character", least(1e0, sc) AS scenic, 0.5e0 AS elevation FROM rolled, par),
 scored AS (SELECT *, least(1e0, greatest(0e0, w0 * flow + w1 * safety + w2 * surface + w3 * "character" + w4 * scenic + w5 * elevation)) AS overall FROM dims)"""


def _way_members(edges: DataFrame) -> DataFrame:
    """One group a way, its forward edges in order."""
    return edges.where(~F.col("id").endswith(":r")).select(F.col("osm_way_id").alias("id"), F.col("seq").alias("pos"), F.col("id").alias("edge_id"))


@query(
    _ROLLED + """ SELECT CAST(way_id AS VARCHAR) AS id, round(m, 4) AS length_m, n_edges AS edge_count, c AS road_class, s AS surface, round(k, 6) AS surface_confidence, bi AS bicycle_infra_continuity,
 pe AS pedestrian_path_continuity, se AS separation_continuity, ca AS traffic_calming_continuity, sc AS scenic_score, round(v, 6) AS average_speed_limit, round(sd, 6) AS stop_density,
 round(cd, 6) AS crossing_density, CAST(0 AS BIGINT) AS turns, CAST(NULL AS DOUBLE) AS elevation_gain, CAST(NULL AS DOUBLE) AS hilliness, one_way, CAST(start_node AS VARCHAR) AS start_node,
 CAST(end_node AS VARCHAR) AS end_node FROM rolled""",
    observed=True,
)
def agg_15_way_rollup(spark, d):
    e = _graph(spark, d).edges
    r = corridors.roll_up(_way_members(e), e)
    six = lambda c: F.round(c, 6).alias(c)
    shares = ("bicycle_infra_continuity", "pedestrian_path_continuity", "separation_continuity", "traffic_calming_continuity", "scenic_score")
    return r.select(
        "id", F.round("length_m", 4).alias("length_m"), _long("edge_count"), "road_class", "surface", six("surface_confidence"), *map(six, shares), six("average_speed_limit"),
        six("stop_density"), six("crossing_density"), "turns", "elevation_gain", "hilliness", "one_way", "start_node", "end_node",
    )


@query(
    f""", w AS ({_WAY}), by_name AS (SELECT from_node % 8 AS g, name, sum(length_m) AS m FROM w GROUP BY 1, 2)
 SELECT CAST(g AS BIGINT) AS chain_id, round(coalesce(max(m) FILTER (name IS NOT NULL), 0) / sum(m), 6) AS name_share FROM by_name GROUP BY 1""",
    observed=True,
)
def agg_17_name_share(spark, d):
    e = _graph(spark, d).edges
    m = e.where(~F.col("id").endswith(":r")).select(
        (F.col("from_node").cast("long") % 8).alias("chain_id"), F.col("seq").alias("pos"), F.col("id").alias("edge_id")
    )
    return chains.name_shares(m, e).select("chain_id", F.round("name_share", 6).alias("name_share"))


@query(
    f""", w AS ({_WAY}), deg AS (SELECT from_node AS node, count(*) AS n FROM edges0 GROUP BY 1 HAVING count(*) > 2),
 busy AS (SELECT way_id, count(DISTINCT node) AS nb FROM (SELECT way_id, unnest([from_node, to_node]) AS node FROM w) JOIN deg USING (node) GROUP BY 1),
 r AS (SELECT way_id, any_value(road_class) AS c, any_value(is_separated) AS sep, any_value(speed_limit) AS v, any_value(has_pedestrian_path) AS ped, any_value(has_traffic_calming) AS calm,
 sum(stops + signals + crossings) / (sum(length_m) / 1000) AS sd, coalesce(any_value(nb), 0) / (sum(length_m) / 1000) AS cd FROM w LEFT JOIN busy USING (way_id) GROUP BY 1)
 SELECT CAST(way_id AS VARCHAR) AS id, CASE WHEN c IN ('cycleway', 'path') AND sep THEN 'trail' WHEN c IN ('footway', 'path') THEN 'path' WHEN c IN ('primary', 'trunk') THEN 'arterial'
 WHEN c IN ('secondary', 'tertiary') THEN 'collector' WHEN c IN ('residential', 'unclassified', 'service') AND coalesce(v, 0) <= 40
 THEN CASE WHEN cd < 4 AND sd < 2 AND NOT ped AND NOT calm THEN 'rural-road' ELSE 'neighborhood' END ELSE 'mixed' END AS type FROM r""",
    observed=True,
)
def cls_01_way_types(spark, d):
    e = _graph(spark, d).edges
    rolled = corridors.roll_up(_way_members(e), e).withColumn("average_speed_limit", F.round("average_speed_limit", 6))
    return rolled.select("id", corridors.corridor_type().alias("type"))


_JOINED = f""", w AS ({_WAY}), tips AS (SELECT a AS node, way_id, start_pos, 0 AS side, highway FROM segments JOIN ways0 USING (way_id)
  UNION ALL SELECT b, way_id, start_pos, 1, highway FROM segments JOIN ways0 USING (way_id)),
 firsts AS (SELECT node, arg_min(highway, [way_id, start_pos, side]) AS by_way FROM tips GROUP BY 1),
 flags AS (SELECT f.node, n.hw IS NOT DISTINCT FROM 'traffic_signals' AS s, n.hw IS NOT DISTINCT FROM 'stop' OR n.hw IS NOT DISTINCT FROM 'crossing' OR (by_way IN {D.TRAIL_SQL} AND k.meets) AS t
  FROM firsts f JOIN nodes0 n ON n.id = f.node JOIN counted k ON k.node_id = f.node),
 x AS (SELECT way_id, sum(length_m) AS m, bool_or(road_class IN ('primary', 'secondary', 'trunk')) AS crosses_major, bool_or(signals > 0) AS sig, bool_or(stops > 0 OR crossings > 0) AS stp,
  min_by(from_node, pos) AS a, max_by(to_node, pos) AS b FROM w GROUP BY 1),
 y AS (SELECT x.way_id, m, crosses_major, sig OR p.s OR q.s AS has_signal, stp OR p.t OR q.t AS has_stop FROM x JOIN flags p ON p.node = x.a JOIN flags q ON q.node = x.b),
 connected AS (SELECT *, CASE WHEN crosses_major THEN CASE WHEN has_signal THEN 0.3e0 ELSE 0.7e0 END WHEN has_stop THEN 0.2e0 WHEN has_signal THEN 0.15e0 ELSE 0.1e0 END AS difficulty FROM y)"""


@query(_JOINED + " SELECT CAST(way_id AS VARCHAR) AS id, round(m, 4) AS length_m, crosses_major, has_signal, has_stop, difficulty FROM connected", observed=True)
def agg_26_way_connectors(spark, d):
    g = _graph(spark, d)
    out = corridors.connector_attributes(_way_members(g.edges), g)
    return out.select("id", F.round("length_m", 4).alias("length_m"), "crosses_major", "has_signal", "has_stop", "difficulty")


@query(
    f""", w AS ({_WAY}), e AS (SELECT DISTINCT way_id, unnest([from_node, to_node]) AS node FROM w)
 SELECT DISTINCT CAST(x.way_id AS VARCHAR) AS a, CAST(y.way_id AS VARCHAR) AS b FROM e x JOIN e y USING (node) WHERE x.way_id <> y.way_id""",
    observed=True,
)
def join_11_adjacency(spark, d):
    e = _graph(spark, d).edges
    return corridors.adjacency(_way_members(e), e)


def _way_corridors(spark, d, e: DataFrame | None = None) -> DataFrame:
    e = _graph(spark, d).edges if e is None else e
    none = "struct<surface:double,speed_limit:double,traffic_control:double,infrastructure:double,scenic:double,elevation:double>"
    # a mean of equal limits is that limit, whatever the order of its sums
    rolled = corridors.roll_up(_way_members(e), e).withColumn("average_speed_limit", F.round("average_speed_limit", 6))
    return rolled.withColumn("type", corridors.corridor_type()).withColumn("confidence", F.lit(None).cast(none))


@query(_scored(simple=True) + " SELECT CAST(way_id AS VARCHAR) AS id, activity, round(flow, 6) AS flow FROM scored", observed=True)
def sco_01_flow(spark, d):
    s = scoring.score_corridors(_way_corridors(spark, d), {a: scoring.simple_defaults(a) for a in scoring.ACTIVITIES})
    return s.select("id", "activity", F.round("flow", 6).alias("flow"))


@query(_scored(simple=True) + " SELECT CAST(way_id AS VARCHAR) AS id, activity, round(safety, 6) AS safety FROM scored", observed=True)
def sco_03_safety(spark, d):
    s = scoring.score_corridors(_way_corridors(spark, d), {a: scoring.simple_defaults(a) for a in scoring.ACTIVITIES})
    return s.select("id", "activity", F.round("safety", 6).alias("safety"))


@query(
    f""", w AS ({_WAY}), r AS (SELECT way_id, any_value(surface) AS s, any_value(surface_confidence) AS k FROM w GROUP BY 1)
 SELECT CAST(way_id AS VARCHAR) AS id, a.activity, round(CASE s WHEN 'paved' THEN p WHEN 'unpaved' THEN u ELSE q END * (0.5 + 0.5 * k), 6) AS surface_score FROM r,
 (VALUES ('road-cycling', 1.0, 0.0, 0.3), ('gravel-cycling', 0.4, 1.0, 0.4), ('running', 0.7, 0.9, 0.4), ('walking', 0.8, 0.8, 0.5)) a(activity, p, u, q)""",
    observed=True,
)
def sco_04_surface(spark, d):
    s = scoring.score_corridors(_way_corridors(spark, d))
    return s.select("id", "activity", F.round("surface", 6).alias("surface_score"))


@query(
    _scored() + """ SELECT CAST(way_id AS VARCHAR) AS id, activity, round(overall, 6) AS overall, round(flow, 6) AS flow, round(safety, 6) AS safety, round(surface, 6) AS surface,
 round("character", 6) AS "character", round(scenic, 6) AS scenic, round(elevation, 6) AS elevation FROM scored""",
    observed=True,
)
def sco_09_overall(spark, d):
    s = scoring.score_corridors(_way_corridors(spark, d))
    return s.select("id", "activity", *[F.round(c, 6).alias(c) for c in ("overall", *scoring.DIMENSIONS)])


@query(
    _scored() + """, o AS (SELECT activity, list_sort(list(round(overall, 9))) AS o FROM scored GROUP BY 1)
 SELECT activity, round(o[CAST(least(floor(len(o) * 0.05e0), len(o) - 1) AS INT) + 1], 6) AS p5, round(o[CAST(least(floor(len(o) * 0.95e0), len(o) - 1) AS INT) + 1], 6) AS p95 FROM o""",
    observed=True,
)
def agg_25_score_range(spark, d):
    s, out = settled(scoring.score_corridors(_way_corridors(spark, d)), "scores"), None
    for a in scoring.ACTIVITIES:
        row = export.score_range(s.where(F.col("activity") == a)).select(F.lit(a).alias("activity"), F.round("p5", 6).alias("p5"), F.round("p95", 6).alias("p95"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    _ROLLED + """, v AS (SELECT 'length_m' AS attribute, unnest(list(m)) AS v FROM rolled UNION ALL SELECT 'surface_confidence', unnest(list(k)) FROM rolled UNION ALL SELECT 'turns', 0e0 FROM rolled),
 o AS (SELECT attribute, v, row_number() OVER (PARTITION BY attribute ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY attribute) AS n FROM v)
 SELECT attribute, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most, round(max(v) FILTER (i = least(floor(n * 0.5e0), n - 1)), 4) AS p50 FROM o GROUP BY 1""",
    observed=True,
)
def agg_22_corridor_spreads(spark, d):
    r = reports.corridor_spreads(settled(_way_corridors(spark, d), "rolled"))
    return r.select("attribute", *[F.round(c, 4).alias(c) for c in ("mean", "least", "most", "p50")])


@query(
    _ROLLED + """, v AS (SELECT unnest([{'a': 'bicycle_infra_continuity', 'v': bi, 'h': bi > 0}, {'a': 'pedestrian_path_continuity', 'v': pe, 'h': pe > 0}, {'a': 'separation_continuity', 'v': se, 'h': se > 0},
  {'a': 'traffic_calming_continuity', 'v': ca, 'h': ca > 0}, {'a': 'scenic_score', 'v': sc, 'h': sc > 0}, {'a': 'stop_density', 'v': sd, 'h': sd > 0}, {'a': 'crossing_density', 'v': cd, 'h': cd > 0},
  {'a': 'average_speed_limit', 'v': v, 'h': v IS NOT NULL}, {'a': 'low surface_confidence', 'v': k, 'h': k < 0.3}]) AS x FROM rolled)
 SELECT x.a AS attribute, round(coalesce(avg(x.v), 0), 6) AS mean, count(*) FILTER (x.h) AS n, round(count(*) FILTER (x.h) / count(*), 8) AS share FROM v GROUP BY 1""",
    observed=True,
)
def agg_22_corridor_shares(spark, d):
    c = _way_corridors(spark, d).withColumn("surface_confidence", F.round("surface_confidence", 9))
    r = reports.corridor_shares(c)
    return r.select("attribute", F.round("mean", 6).alias("mean"), "n", F.round("share", 8).alias("share"))


@query(
    _JOINED + """ SELECT count(*) AS connectors, round(avg(m), 4) AS mean_m, round(min(m), 4) AS least_m, round(max(m), 4) AS most_m, count(*) FILTER (has_signal) AS with_signal,
 count(*) FILTER (has_stop) AS with_stop, count(*) FILTER (crosses_major) AS crossing_major, round(avg(difficulty), 6) AS mean_difficulty FROM connected""",
    observed=True,
)
def agg_23_connector_report(spark, d):
    g = _graph(spark, d)
    r = reports.connector_report(corridors.connector_attributes(_way_members(g.edges), g))
    return r.withColumns({c: F.round(c, 4) for c in ("mean_m", "least_m", "most_m")} | {"mean_difficulty": F.round("mean_difficulty", 6)})


@query(_ROLLED + " SELECT type, count(*) AS n, round(sum(m) / 1000, 4) AS km, round(count(*) / (SELECT count(*) FROM rolled), 8) AS share FROM rolled GROUP BY 1", observed=True)
def agg_32_type_breakdown(spark, d):
    r = reports.corridor_distribution(_way_corridors(spark, d), "type")
    return r.select("type", "n", F.round("km", 4).alias("km"), F.round("share", 8).alias("share"))


def _way_network(spark, d, g: sg.Graph | None = None) -> corridors.Network:
    """Ways of even numbers as corridors, of odd ones as connectors of the corridors that they touch."""
    g = g or _settled_graph(spark, d)
    members = settled(_way_members(g.edges), "members")
    lines = corridors.geometries(members, g.edges, 1e-3)
    near, even = settled(corridors.adjacency(members, g.edges), "adjacency"), F.col("id").cast("long") % 2 == 0
    own = _way_corridors(spark, d, g.edges).where(even).join(shuffled(lines), "id").withColumn("is_destination", F.col("id").cast("long") % 10 == 0)
    links = near.where((F.col("a").cast("long") % 2 == 1) & (F.col("b").cast("long") % 2 == 0)).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("corridor_ids"))
    joining = corridors.connector_attributes(members.where(~even), g).join(shuffled(links), "id").join(shuffled(lines), "id")
    return corridors.Network(own, joining, members, near)


_LOCATED = _ROLLED + f""", e AS (SELECT DISTINCT way_id, unnest([from_node, to_node]) AS node FROM w),
 adj AS (SELECT DISTINCT x.way_id AS a, y.way_id AS b FROM e x JOIN e y USING (node) WHERE x.way_id <> y.way_id),
 box AS (SELECT 42.93e0 - 1 / 111.32e0 AS y1, 42.93e0 + 1 / 111.32e0 AS y2, -85.68e0 - 1 / 111.32e0 / cos(radians(42.93e0)) AS x1, -85.68e0 + 1 / 111.32e0 / cos(radians(42.93e0)) AS x2),
 tip AS (SELECT way_id, min(pos) AS lo, max(stop) AS hi FROM w GROUP BY 1),
 own AS (SELECT DISTINCT r.way_id, m, r.way_id % 10 = 0 AS dest FROM rolled r JOIN tip USING (way_id) JOIN known k ON k.way_id = r.way_id AND (k.pos = lo OR k.pos = hi), box
  WHERE r.way_id % 2 = 0 AND k.lat BETWEEN y1 AND y2 AND k.lng BETWEEN x1 AND x2),
 joined AS (SELECT a AS way_id, count(DISTINCT b) AS n FROM adj JOIN own ON own.way_id = b WHERE a % 2 = 1 GROUP BY 1)"""


@query(
    _LOCATED + """ SELECT 'corridor' AS kind, CAST(way_id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS n FROM own UNION ALL SELECT 'connector', CAST(way_id AS VARCHAR), n FROM joined
 UNION ALL SELECT 'links', CAST(a AS VARCHAR), count(*) FROM adj WHERE a IN (SELECT way_id FROM own UNION SELECT way_id FROM joined) AND b IN (SELECT way_id FROM own UNION SELECT way_id FROM joined) GROUP BY 2""",
    observed=True,
)
def join_20_location_filter(spark, d):
    core, _ = location.boxes(spark, 42.93, -85.68, 1.0)
    net = location.within_box(_way_network(spark, d), core)
    own = net.corridors.select(F.lit("corridor").alias("kind"), "id", F.lit(None).cast("long").alias("n"))
    joining = net.connectors.select(F.lit("connector").alias("kind"), "id", F.size("corridor_ids").cast("long").alias("n"))
    links = net.adjacency.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).select(F.lit("links").alias("kind"), "id", "n")
    return own.unionByName(joining).unionByName(links)


@query(
    _LOCATED + """ SELECT count(*) AS corridors, count(*) FILTER (dest) AS destinations, round(coalesce(avg(m), 0), 4) AS mean_m, round(coalesce(sum(m), 0), 4) AS total_m,
 (SELECT count(*) FROM joined) AS connectors FROM own""",
    observed=True,
)
def gra_07_location_stats(spark, d):
    core, _ = location.boxes(spark, 42.93, -85.68, 1.0)
    return location.location_stats(location.within_box(_way_network(spark, d), core)).withColumns({c: F.round(c, 4) for c in ("mean_m", "total_m")})


@query(
    f""", w AS ({_WAY}), h AS (SELECT id, 180e0 + (id * 37) % 101 * 0.5e0 AS z FROM nodes0),
 pt AS (SELECT w.way_id, w.pos AS edge, k.pos AS k, CASE WHEN k.pos > w.pos THEN s.d ELSE 0 END AS step, CASE WHEN one_way AND reversed THEN -1 ELSE 1 END AS turn, a.z AS za, b.z AS zb
  FROM w JOIN known k ON k.way_id = w.way_id AND k.pos BETWEEN w.start_pos AND w.stop JOIN stepped s ON s.way_id = k.way_id AND s.pos = k.pos
  JOIN h a ON a.id = w.a JOIN h b ON b.id = w.b WHERE NOT (one_way AND reversed)),
 along AS (SELECT *, sum(step) OVER (PARTITION BY way_id, edge ORDER BY k) AS x, sum(step) OVER (PARTITION BY way_id, edge) AS len,
  sum(step) OVER (PARTITION BY way_id ORDER BY edge, k ROWS UNBOUNDED PRECEDING) AS dist FROM pt),
 sm AS (SELECT way_id, dist, za + x / len * (zb - za) AS z, row_number() OVER q AS n, lead(dist) OVER q AS d1, lead(za + x / len * (zb - za)) OVER q AS z1, max(dist) OVER (PARTITION BY way_id) AS total
  FROM along WINDOW q AS (PARTITION BY way_id ORDER BY edge, k)),
 g AS (SELECT way_id, z + CASE WHEN d1 > dist THEN (50 * i - dist) / (d1 - dist) ELSE 0 END * (z1 - z) AS z FROM sm, LATERAL (SELECT unnest(range(CASE WHEN n = 1 THEN 0 ELSE CAST(floor(dist / 50) AS BIGINT) + 1 END,
  CAST(floor(d1 / 50) AS BIGINT) + 1)) AS i) WHERE d1 IS NOT NULL UNION ALL SELECT way_id, z FROM sm WHERE d1 IS NULL AND total - floor(total / 50) * 50 > 5)
 SELECT CAST(way_id AS VARCHAR) AS id, count(*) AS samples, round(sum(z), 4) AS total, round(min(z), 4) AS least, round(max(z), 4) AS most FROM g GROUP BY 1""",
    observed=True,
)
def win_04_profiles(spark, d):
    e = _graph(spark, d).edges
    ways = D.osm_ways(spark, d).where(T.reversed_one_way(F.col("tags"))).select(F.col("id").cast("string").alias("id"))
    heights = D.osm_nodes(spark, d).select(F.col("id").cast("string").alias("node"), (F.lit(180.0) + (F.col("id") * 37) % 101 * 0.5).alias("z"))
    p = elevation.profiles(_way_members(e).join(shuffled(ways), "id", "left_anti"), e, node_heights=heights)
    total = F.aggregate("profile", F.lit(0.0), lambda s, z: s + z)
    return p.select("id", F.size("profile").cast("long").alias("samples"), F.round(total, 4).alias("total"), F.round(F.array_min("profile"), 4).alias("least"), F.round(F.array_max("profile"), 4).alias("most"))


@query(
    _scored() + """, q AS (SELECT way_id % 50 AS request_id, overall, flow, m FROM scored WHERE activity = 'walking')
 SELECT request_id, round(sum(overall * m) / sum(m), 6) AS overall, round(sum(flow * m) / sum(m), 6) AS flow FROM q GROUP BY 1""",
    observed=True,
)
def agg_30_route_scores(spark, d):
    c = settled(_way_corridors(spark, d), "rolled")
    s = scoring.score_corridors(c, {"walking": scoring.defaults("walking")})
    r = reports.route_scores(c.select((F.col("id").cast("long") % 50).alias("request_id"), "id", "length_m"), s)
    return r.select("request_id", F.round("overall", 6).alias("overall"), F.round("flow", 6).alias("flow"))


@query()
def gra_06_network(spark, d):
    g = _settled_graph(spark, d)
    return corridors.network_stats(corridors.build_network(g, by_tier=dict.fromkeys(chains.MIN_LENGTH_M, 200.0)))


@query()
def gra_16_loops(spark, d):
    g = _settled_graph(spark, d)
    net = corridors.build_network(g, by_tier=dict.fromkeys(chains.MIN_LENGTH_M, 200.0))
    net = corridors.Network(settled(net.corridors, "corridors"), settled(net.connectors, "connectors"), settled(net.entity_edges, "entities"), net.adjacency)
    scores = scoring.score_corridors(net.corridors)
    c = D.table(spark, d, "customer")
    starts = c.select(
        F.col("c_custkey").cast("long").alias("request_id"),
        (F.lit(42.9) + F.col("c_custkey") % 40 * 0.0027).alias("lat"),
        (F.lit(-85.7) + F.col("c_custkey") % 50 * 0.0014).alias("lng"),
        F.lit(2000.0).alias("min_m"),
        F.lit(6000.0).alias("max_m"),
        (F.col("c_custkey") % 360).cast("double").alias("direction"),
        F.lit("moderate").alias("turns"),
        F.col("c_custkey").cast("long").alias("seed"),
    )
    loops = settled(search.loop_routes(starts, net, g, scores, "walking", noise=0.0), "loops")
    return search.route_stats(search.segments(loops, net, g), net.corridors).select("request_id", "distance_m", "stops", "infrastructure", "flow")


# More of ways as chains, corridors and features.


def _way_chains(edges: DataFrame) -> DataFrame:
    """One chain a way, its forward edges in order."""
    return edges.where(~F.col("id").endswith(":r")).select(F.col("osm_way_id").cast("long").alias("chain_id"), F.col("seq").alias("pos"), F.col("id").alias("edge_id"))


@query(
    _ROLLED + """ SELECT way_id AS chain_id, round(m, 4) AS length_m, CASE WHEN c IN ('cycleway', 'path', 'footway') AND se > 0 THEN 'dedicated' WHEN name IS NOT NULL AND bi > 0 THEN 'named bike'
 WHEN name IS NOT NULL THEN 'named' ELSE 'unnamed' END AS tier FROM rolled""",
    observed=True,
)
def cls_02_way_tiers(spark, d):
    e = _graph(spark, d).edges
    return chains.tiers(_way_chains(e), e).select("chain_id", F.round("length_m", 4).alias("length_m"), "tier")


@query(
    _ROLLED + """, t AS (SELECT *, CASE WHEN c IN ('cycleway', 'path', 'footway') AND se > 0 THEN 400e0 WHEN name IS NOT NULL AND bi > 0 THEN 800e0 ELSE 1609e0 END AS least FROM rolled)
 SELECT way_id AS chain_id, round(least * CASE WHEN name IS NOT NULL THEN 0.5e0 ELSE 1 END, 4) AS min_length_m FROM t""",
    observed=True,
)
def cls_03_min_lengths(spark, d):
    e = settled(_graph(spark, d).edges, "edges")
    return chains.min_lengths(_way_chains(e), e).select("chain_id", F.round("min_length_m", 4).alias("min_length_m"))


@query(
    _ROLLED + """ SELECT way_id AS chain_id FROM rolled WHERE m >= 500 AND c NOT IN ('service', 'motorway', 'trunk')
 AND ((c IN ('cycleway', 'path', 'track') AND m >= 800) OR (name IS NOT NULL AND m >= 1000))""",
    observed=True,
)
def cls_04_destinations(spark, d):
    e = settled(_graph(spark, d).edges, "edges")
    return chains.destinations(_way_chains(e), e)


@query(
    f""", w AS ({_WAY}), m AS (SELECT *, way_id // 4 AS chain, row_number() OVER (PARTITION BY way_id // 4 ORDER BY way_id, pos) AS k FROM w),
 grp AS (SELECT unnest(['motorway','trunk','primary','secondary','tertiary','residential','service','unclassified','cycleway','path','footway','track']) AS c,
  unnest([0,1,2,3,4,5,5,5,6,7,7,8]) AS g, unnest([0,1,2,3,4,5,6,6,7,8,8,9]) AS r),
 p AS (SELECT a.chain, CASE WHEN abs(a.speed_limit - b.speed_limit) > 15 OR x.g <> y.g THEN 0 ELSE 0.42e0 * CASE WHEN a.road_class = b.road_class THEN 1 ELSE greatest(0, 1 - 0.3e0 * abs(x.r - y.r)) END
  + 0.23e0 * CASE WHEN a.surface = b.surface THEN 1 ELSE 0.5e0 END + 0.18e0 * ((a.has_bicycle_infra = b.has_bicycle_infra)::INT + (a.has_pedestrian_path = b.has_pedestrian_path)::INT + 1
  + (a.is_separated = b.is_separated)::INT + (a.has_traffic_calming = b.has_traffic_calming)::INT) / 5e0 + 0.10e0 * CASE WHEN a.name IS NOT DISTINCT FROM b.name THEN 1 ELSE 0.5e0 END
  + 0.07e0 * CASE WHEN a.pos % 7 = 0 OR b.pos % 7 = 0 THEN CASE WHEN a.pos % 7 = 0 AND b.pos % 7 = 0 THEN 1 ELSE 0.8e0 END
   ELSE least(1, greatest(0, 1 - (abs((a.pos * 3 + a.way_id) % 17 - (b.pos * 3 + b.way_id) % 17) - 2) / 8e0)) END END AS score
  FROM m a JOIN m b ON b.chain = a.chain AND b.k = a.k + 1 JOIN grp x ON x.c = a.road_class JOIN grp y ON y.c = b.road_class)
 SELECT chain AS chain_id, round(coalesce(avg(score), 1), 6) AS homogeneity FROM (SELECT DISTINCT chain FROM m) LEFT JOIN p USING (chain) GROUP BY 1""",
    observed=True,
)
def agg_18_homogeneity(spark, d):
    """Four ways a chain, with grades made up from their places."""
    e = _graph(spark, d).edges.withColumn("start", F.regexp_extract("id", ":([0-9]+)", 1).cast("long"))
    e = e.withColumn("average_grade", F.when(F.col("start") % 7 != 0, ((F.col("start") * 3 + F.col("osm_way_id").cast("long")) % 17).cast("double")))
    e = settled(e.drop("start"), "edges")
    members = e.where(~F.col("id").endswith(":r")).select(F.floor(F.col("osm_way_id").cast("long") / 4).cast("long").alias("chain_id"), F.col("seq").alias("pos"), F.col("id").alias("edge_id"))
    return chains.homogeneity(members, e).select("chain_id", F.round("homogeneity", 6).alias("homogeneity"))


@query(
    f""", w AS ({_WAY}), x AS (SELECT way_id, length_m AS m, CASE WHEN way_id % 2 = 0 THEN 0.1e0 * (pos % 9 + 1) END AS s, CASE WHEN way_id % 3 = 0 THEN 0.05e0 * (pos % 11) END AS t,
  CASE WHEN way_id % 3 = 0 AND way_id % 4 = 0 THEN 0.6e0 END AS r FROM w)
 SELECT CAST(way_id AS VARCHAR) AS id, round(coalesce(sum(s * m) / sum(m) FILTER (s IS NOT NULL), 0), 6) AS surface,
 round(coalesce(sum(greatest(t, r) * m) / sum(m) FILTER (t IS NOT NULL OR r IS NOT NULL), 0), 6) AS traffic_control, 0e0 AS elevation FROM x WHERE way_id % 2 = 0 OR way_id % 3 = 0 GROUP BY 1""",
    observed=True,
)
def agg_16_confidences(spark, d):
    way, start = F.col("osm_way_id").cast("long"), F.regexp_extract("id", ":([0-9]+)", 1).cast("long")
    entries = F.array(
        F.struct(F.lit("surface").alias("k"), F.when(way % 2 == 0, 0.1 * (start % 9 + 1)).alias("v")),
        F.struct(F.lit("stop-sign").alias("k"), F.when(way % 3 == 0, 0.05 * (start % 11)).alias("v")),
        F.struct(F.lit("road-crossing").alias("k"), F.when((way % 3 == 0) & (way % 4 == 0), F.lit(0.6)).alias("v")),
    )
    known = F.filter(entries, lambda x: x["v"].isNotNull())
    e = _graph(spark, d).edges.withColumn("enrichment", F.when(F.size(known) > 0, F.map_from_entries(known)))
    c = corridors.confidences(_way_members(e), e)
    return c.select("id", *[F.round(f"confidence.{k}", 6).alias(k) for k in ("surface", "traffic_control", "elevation")])


@query(" SELECT least(n, 10) AS degree, count(*) AS nodes FROM (SELECT from_node, count(*) AS n FROM edges0 GROUP BY 1) GROUP BY 1", observed=True)
def agg_28_degree_histogram(spark, d):
    return search.degree_histogram(_graph(spark, d).edges).select(F.col("degree").cast("long").alias("degree"), "nodes")


@query(
    _scored() + f""", e AS (SELECT DISTINCT way_id, unnest([from_node, to_node]) AS node FROM w),
 adj AS (SELECT DISTINCT x.way_id AS a, y.way_id AS b FROM e x JOIN e y USING (node) WHERE x.way_id <> y.way_id), own AS (SELECT way_id, 'corridor' AS kind, one_way, overall AS score FROM scored JOIN (SELECT way_id, one_way FROM rolled) USING (way_id) WHERE activity = 'walking' AND way_id % 2 = 0),
 links AS (SELECT a AS way_id FROM adj WHERE a % 2 = 1 AND b % 2 = 0 GROUP BY 1 HAVING count(*) >= 2),
 every AS (SELECT way_id, kind, one_way FROM own UNION ALL SELECT way_id, 'connector', false FROM links),
 moves AS (SELECT w.from_node AS u, w.to_node AS v, w.id AS edge_id, x.kind, x.way_id FROM w JOIN every x USING (way_id) UNION ALL
  SELECT w.to_node, w.from_node, w.id, x.kind, x.way_id FROM w JOIN every x USING (way_id) WHERE NOT x.one_way)
 SELECT CAST(u AS VARCHAR) AS from_node, CAST(v AS VARCHAR) AS to_node, edge_id, moves.kind AS kind, round(score, 6) AS score FROM moves LEFT JOIN own USING (way_id)""",
    observed=True,
)
def join_15_search_edges(spark, d):
    g = _settled_graph(spark, d)
    net = _way_network(spark, d, g)
    s = scoring.score_corridors(net.corridors, {"walking": scoring.defaults("walking")})
    rows = search.search_edges(net, g, s, "walking")
    return rows.select("from_node", "to_node", "edge_id", "kind", F.when(F.col("kind") == "corridor", F.round("score", 6)).alias("score"))


@query(
    _ROLLED + """ SELECT (SELECT count(*) FROM rolled WHERE way_id % 2 = 0) AS corridors, round(sum(m) FILTER (way_id % 2 = 0), 2) AS total_m, round(avg(m) FILTER (way_id % 2 = 0), 4) AS mean_m FROM rolled""",
    observed=True,
)
def agg_27_network_stats(spark, d):
    s = corridors.network_stats(_way_network(spark, d))
    return s.select("corridors", F.round("total_m", 2).alias("total_m"), F.round("mean_m", 4).alias("mean_m"))


@query(
    f""", w AS ({_WAY}), t AS (SELECT way_id, min(start_pos) AS lo, max(stop) AS hi, any_value(one_way AND reversed) AS back, count(*) AS n_edges FROM w GROUP BY 1)
 SELECT CAST(t.way_id AS VARCHAR) AS id, CAST(2 AS BIGINT) AS points, round(CASE WHEN back AND n_edges = 1 THEN q.lat ELSE p.lat END, 7) AS lat, round(CASE WHEN back AND n_edges = 1 THEN q.lng ELSE p.lng END, 7) AS lng FROM t
 JOIN known p ON p.way_id = t.way_id AND p.pos = lo JOIN known q ON q.way_id = t.way_id AND q.pos = hi WHERE NOT back OR n_edges = 1""",
    observed=True,
)
def geo_16_way_geometry(spark, d):
    """Straight ways keep their two ends; turned ways of several edges are not continuous and are left out."""
    e = _graph(spark, d).edges
    turned = D.osm_ways(spark, d).where(T.reversed_one_way(F.col("tags"))).select(F.col("id").cast("string").alias("id"))
    many = _way_members(e).groupBy("id").count().where("count > 1").select("id")
    g = corridors.geometries(_way_members(e).join(shuffled(turned.join(shuffled(many), "id", "left_semi")), "id", "left_anti"), e)
    return g.select("id", F.size("geometry").cast("long").alias("points"), F.round(F.col("geometry")[0]["lat"], 7).alias("lat"), F.round(F.col("geometry")[0]["lng"], 7).alias("lng"))


@query(
    f"WITH {D.NODES_SQL}" + """ SELECT id, round(lat - 3 / 111.32e0, 8) AS min_lat, round(lat + 3 / 111.32e0, 8) AS max_lat,
 round(lng - 2 / 111.32e0 / cos(radians(lat)) - 1 / 111.32e0 / cos(radians(lat)), 8) AS min_lng, round(lng + 3 / 111.32e0 / cos(radians(lat)), 8) AS max_lng FROM nodes0"""
)
def geo_12_box_grown(spark, d):
    box = geo.box_grown(geo.box_around(F.col("lat"), F.col("lon"), F.lit(2.0)), F.lit(1.0))
    return D.osm_nodes(spark, d).select("id", *[F.round(v, 8).alias(k) for k, v in box.items()])


@query(" SELECT id, bool_or(lat BETWEEN 42.92 AND 42.95 AND lng BETWEEN -85.69 AND -85.66) AS inside FROM edges0 e JOIN known k ON k.way_id = e.way_id AND k.pos BETWEEN e.start_pos AND e.stop GROUP BY 1", graph=True)
def geo_13_touches_box(spark, d):
    box = {k: F.lit(v) for k, v in {"min_lat": 42.92, "max_lat": 42.95, "min_lng": -85.69, "max_lng": -85.66}.items()}
    return _graph(spark, d).edges.select("id", geo.touches_box(F.col("geometry"), box).alias("inside"))


@query(
    """SELECT n_nationkey AS k, CAST(floor((n_nationkey * 1.3e0 - 7) / 0.75e0) AS BIGINT) AS tile_row, CAST(floor((n_regionkey * 2.9e0 - 5) / 0.75e0) AS BIGINT) AS tile_col,
 round(floor((n_regionkey * 2.9e0 - 5) / 0.75e0) * 0.75e0, 8) AS min_lng, round((floor((n_regionkey * 2.9e0 - 5) / 0.75e0) + 1) * 0.75e0, 8) AS max_lng FROM nation"""
)
def src_08_tile_of_box(spark, d):
    lat, lng = F.col("n_nationkey") * F.lit(1.3) - 7, F.col("n_regionkey") * F.lit(2.9) - 5
    r, c = tiles.tile_of_box({"min_lat": lat - 0.5, "max_lat": lat + 0.5, "min_lng": lng - 4.0, "max_lng": lng + 4.0})
    box = tiles.tile_box(r, c)
    return D.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), r.alias("tile_row"), c.alias("tile_col"), box["min_lng"].alias("min_lng"), box["max_lng"].alias("max_lng"))


_SIGNS = ("regulatory--stop--g1", "regulatory--traffic-signals--g2", "object--traffic-signal--x", "marking--crosswalk-zebra", "object--crosswalk", "object--bench", "stop", "xregulatory--stop")


@query(
    f"""WITH x AS (SELECT event_id AS seq, ([{', '.join(f"'{v}'" for v in _SIGNS)}])[CAST(event_id % {len(_SIGNS)} AS INT) + 1] AS v FROM events),
 y AS (SELECT seq, CASE WHEN starts_with(v, 'regulatory--stop') THEN 'stop-sign' WHEN starts_with(v, 'regulatory--traffic-signal') OR starts_with(v, 'object--traffic-signal') THEN 'traffic-signal'
  WHEN starts_with(v, 'marking--crosswalk') OR starts_with(v, 'object--crosswalk') THEN 'road-crossing' END AS attribute FROM x)
 SELECT seq, attribute, 0.7e0 AS confidence, 0.75e0 AS v_conf FROM y WHERE attribute IS NOT NULL"""
)
def src_18_detections(spark, d):
    from trailweave.sources import detections

    rows = D.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, _SIGNS)), (F.col("event_id") % len(_SIGNS) + 1).cast("int")).alias("object_value"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.lit("2024-01-01T00:00:00Z").alias("last_seen_at"),
    )
    return detections.observations(rows).select("seq", "attribute", "confidence", "v_conf")


@query(
    _scored() + """ SELECT CAST(way_id AS VARCHAR) AS id, CAST(floor(r.m + 0.5) AS BIGINT) AS length, floor(r.m / 1000 * 10 + 0.5) / 10 AS km, floor(round(k, 9) * 100 + 0.5) / 100 AS sure, n_edges AS edges,
 type, CASE type WHEN 'trail' THEN 4.0 WHEN 'path' THEN 3.0 WHEN 'arterial' THEN 3.0 WHEN 'collector' THEN 2.5 ELSE 2.0 END AS width, 0.85e0 AS opacity FROM rolled r""",
    observed=True,
)
def snk_03_corridor_features(spark, d):
    c = _way_corridors(spark, d).withColumn("surface_confidence", F.round("surface_confidence", 9))
    c = c.withColumns({"name": F.lit(None).cast("string"), "is_destination": F.lit(False), "geometry": F.array(*[F.struct(F.lit(float(k)).alias("lat"), F.lit(0.0).alias("lng")) for k in (1, 2)])})
    p = lambda name, kind: F.get_json_object("feature", f"$.properties.{name}").cast(kind)
    return export.corridor_features(c).select(
        "id", p("lengthMeters", "long").alias("length"), p("lengthKm", "double").alias("km"), p("surfaceConfidence", "double").alias("sure"), p("edgeCount", "long").alias("edges"),
        p("corridorType", "string").alias("type"), p("stroke-width", "double").alias("width"), p("stroke-opacity", "double").alias("opacity"),
    )


# From files, tiles, caches, sources.


def _saved_response(spark, d) -> str:
    """The derived nodes and ways as saved responses, some thousand elements a file."""
    lit = lambda x: F.lit(x)
    node = F.struct(lit("node").alias("type"), "id", "lat", "lon", "tags")
    way = F.struct(lit("way").alias("type"), "id", F.col("refs").alias("nodes"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("geometry"), "tags")
    # files are read in the order of their names, and ways keep their order
    nodes = D.osm_nodes(spark, d).select(F.lit(0).alias("part"), F.col("seq"), F.to_json(node).alias("e"))
    ways = D.osm_ways(spark, d).select(F.lit(1).alias("part"), F.col("seq"), F.to_json(way).alias("e"))
    elements = nodes.unionByName(ways).withColumn("file", F.format_string("%d-%012d", "part", F.floor(F.col("seq") / 5000)))
    lists = elements.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "e"))).alias("l"))
    text = F.concat(F.lit('{"version":0.6,"elements":['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))
    path = scratch_path(spark, "responses")
    lists.select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return f"{path}/*/*.txt"


@query(
    """SELECT id, CAST(from_node AS VARCHAR) AS from_node, CAST(to_node AS VARCHAR) AS to_node, round(length_m, 4) AS length_m, road_class, surface, stops AS stop_sign_count,
 signals AS traffic_signal_count, crossings AS road_crossing_count FROM edges0""",
    graph=True,
)
def gra_19_edges_of_a_response(spark, d):
    g = ingest.from_overpass(spark, _saved_response(spark, d))
    counts = [_long(c) for c in ("stop_sign_count", "traffic_signal_count", "road_crossing_count")]
    return g.edges.select("id", "from_node", "to_node", F.round("length_m", 4).alias("length_m"), "road_class", "surface", *counts)


@query(f"WITH {D.NODES_SQL}, {D.WAYS_SQL} SELECT 'node' AS type, count(*) AS n FROM nodes0 UNION ALL SELECT 'way', count(*) FROM ways0")
def src_02_element_counts(spark, d):
    from trailweave.sources import overpass

    return overpass.element_counts(overpass.read_responses(spark, _saved_response(spark, d)))


@query(f"WITH {D.NODES_SQL} SELECT id, CAST(floor(lat / 0.75e0) AS BIGINT) AS tile_row, CAST(floor(lng / 0.75e0) AS BIGINT) AS tile_col FROM nodes0")
def src_06_tiles(spark, d):
    r, c = tiles.tile_of(F.col("lat"), F.col("lon"))
    return D.osm_nodes(spark, d).select("id", r.alias("tile_row"), c.alias("tile_col"))


@query(
    """SELECT n_nationkey AS k, substr(sha256((n_nationkey - 12) || '|' || (n_regionkey * 7) || '|90'), 1, 16) AS key,
 (n_nationkey - 12) * 0.75e0 AS min_lat, (n_nationkey - 11) * 0.75e0 AS max_lat FROM nation"""
)
def src_09_cache_key(spark, d):
    n = D.table(spark, d, "nation")
    r, c = (F.col("n_nationkey") - 12).cast("long"), (F.col("n_regionkey") * 7).cast("long")
    box = tiles.tile_box(r, c)
    return n.select(F.col("n_nationkey").alias("k"), tiles.tile_key(r, c).alias("key"), box["min_lat"].alias("min_lat"), box["max_lat"].alias("max_lat"))


_ROWS = "SELECT p_partkey AS seq, p_partkey % 97 AS osm_id, p_size % 3 = 0 AS has_ml, CASE WHEN p_size % 7 <> 0 THEN p_size END AS n, p_type AS label FROM part"


def _predicted(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return D.table(spark, d, "part").select(
        k.alias("seq"), (k % 97).alias("osm_id"), (s % 3 == 0).alias("has_ml"), F.when(s % 7 != 0, s).cast("long").alias("n"), F.col("p_type").alias("label")
    )


@query(f"SELECT osm_id, seq, CAST(n AS BIGINT) AS n FROM ({_ROWS}) QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY has_ml DESC, coalesce(n, 0) DESC, seq) = 1")
def src_13_dedupe(spark, d):
    return S.one_per_way(_predicted(spark, d)).select("osm_id", "seq", "n")


@query(
    """WITH r AS (SELECT event_id % 4999 AS osm_id, CASE WHEN user_id % 3 = 0 THEN user_id % 4 END AS label, CASE user_id % 5 WHEN 0 THEN 'paved' WHEN 1 THEN 'gravel' WHEN 2 THEN '' WHEN 3 THEN 'unpaved' END AS combined,
  CASE WHEN event_id % 6 > 0 THEN event_id % 13 END AS n, event_id AS seq FROM events WHERE user_id % 3 = 0 OR user_id % 5 <> 4),
 w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY label IS NOT NULL DESC, coalesce(n, 0) DESC, seq) = 1)
 SELECT CAST(osm_id AS VARCHAR) AS osm_way_id, 'surface' AS attribute, 'mapillary' AS source,
  round(CASE WHEN label IS NULL THEN 0.5e0 WHEN coalesce(n, 0) <= 0 THEN 0.6e0 ELSE least(0.9e0, 0.6e0 + 0.03e0 * n) END, 6) AS confidence,
  CASE WHEN label = 0 OR (label IS NULL AND combined = 'paved') THEN 'paved' ELSE 'unpaved' END AS v_str FROM w WHERE label IS NOT NULL OR combined <> ''"""
)
def src_12_surface_observations(spark, d):
    """Rows with a prediction, with a combined surface only, and with neither, as observations of ways."""
    e, u = F.col("event_id"), F.col("user_id")
    label = F.when(u % 3 == 0, u % 4)
    combined = F.when(u % 5 == 0, "paved").when(u % 5 == 1, "gravel").when(u % 5 == 2, "").when(u % 5 == 3, "unpaved")
    rows = D.table(spark, d, "events").where((u % 3 == 0) | (u % 5 != 4)).select(
        (e % 4999).alias("osm_id"), label.alias("label"), label.isNotNull().alias("has_ml"), combined.alias("combined"), F.when(e % 6 > 0, e % 13).alias("n"), e.alias("seq")
    )
    return S.observations(S.one_per_way(rows)).withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH b AS (SELECT c_custkey AS box_id, 40e0 + c_custkey % 37 * 0.11e0 AS y, -90e0 + c_custkey % 53 * 0.13e0 AS x, CASE c_custkey % 4 WHEN 0 THEN 0.01e0 WHEN 1 THEN 0.05e0 WHEN 2 THEN 0.3e0 ELSE 1.5e0 END AS h FROM customer),
 r AS (SELECT p_partkey AS seq, p_partkey % 397 AS osm_id, p_size % 3 = 0 AS has_ml, CASE WHEN p_size % 7 <> 0 THEN p_size END AS n, 40e0 + p_partkey % 401 * 0.01e0 AS y, -90e0 + p_partkey % 701 * 0.01e0 AS x, p_size * 0.0005e0 AS h FROM part)
 SELECT box_id, osm_id, seq FROM b JOIN r ON r.x <= b.x + b.h AND r.x + r.h >= b.x AND r.y <= b.y + b.h AND r.y + r.h >= b.y
 QUALIFY row_number() OVER (PARTITION BY box_id, osm_id ORDER BY has_ml DESC, coalesce(n, 0) DESC, seq) = 1"""
)
def join_19_surfaces_in_boxes(spark, d):
    """Predicted surfaces of many boxes of very different sizes at once."""
    c, k, s = F.col("c_custkey"), F.col("p_partkey"), F.col("p_size")
    at = lambda y, x, h: [y.alias("min_lat"), (y + h).alias("max_lat"), x.alias("min_lng"), (x + h).alias("max_lng")]
    h = F.when(c % 4 == 0, 0.01).when(c % 4 == 1, 0.05).when(c % 4 == 2, 0.3).otherwise(1.5)
    boxes = D.table(spark, d, "customer").select(c.alias("box_id"), *at(F.lit(40.0) + c % 37 * F.lit(0.11), F.lit(-90.0) + c % 53 * F.lit(0.13), h))
    rows = D.table(spark, d, "part").select(
        k.alias("seq"), (k % 397).alias("osm_id"), (s % 3 == 0).alias("has_ml"), F.when(s % 7 != 0, s).cast("long").alias("n"),
        *at(F.lit(40.0) + k % 401 * F.lit(0.01), F.lit(-90.0) + k % 701 * F.lit(0.01), s * F.lit(0.0005)),
    )
    return S.surfaces_in_boxes(rows, boxes).select("box_id", "osm_id", "seq")


@query(
    f"""WITH r AS ({_ROWS}), z AS (SELECT osm_id, min(seq) FILTER (n IS NULL) AS z FROM r GROUP BY 1),
 k AS (SELECT osm_id, seq, n FROM r JOIN z USING (osm_id) WHERE n IS NOT NULL AND (z IS NULL OR seq < z) QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY n DESC, seq) = 1)
 SELECT osm_id, coalesce(k.seq, z.z) AS seq, CASE WHEN z.z IS NULL THEN CAST(k.n AS BIGINT) END AS n FROM z LEFT JOIN k USING (osm_id)"""
)
def src_23_upsert(spark, d):
    return S.upserted(_predicted(spark, d)).select("osm_id", "seq", "n")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN 0.6e0 WHEN p_size % 13 >= 10 THEN 0.9e0 ELSE round(0.6e0 + 0.03e0 * (p_size % 13), 6) END AS confidence FROM part")
def src_15_prediction_confidence(spark, d):
    n = F.col("p_size") % 13
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(tiles.prediction_confidence(n), 6).alias("confidence"))


@query(
    """WITH b AS (SELECT n_nationkey AS k, greatest(1, CAST(ceil((n_regionkey + 1) * 0.4e0 / 0.5e0 - 2e-9) AS INT)) AS rows, 2 AS cols, (n_regionkey + 1) * 0.4e0 AS h FROM nation)
 SELECT k, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(10 + r * h / rows, 8) AS min_lat, round(20 + c * 0.4e0, 8) AS min_lng
 FROM (SELECT *, unnest(range(0, rows)) AS r FROM b), (SELECT unnest(range(0, 2)) AS c)"""
)
def src_17_subdivide(spark, d):
    h = (F.col("n_regionkey") + 1) * F.lit(0.4)
    box = {"min_lat": F.lit(10.0), "max_lat": F.lit(10.0) + h, "min_lng": F.lit(20.0), "max_lng": F.lit(20.8)}
    parts = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(tiles.sub_boxes(box, 0.5)).alias("i", "b"))
    return parts.select(
        "k", F.floor(F.col("i") / 2).cast("long").alias("r"), (F.col("i") % 2).cast("long").alias("c"), F.round("b.min_lat", 8).alias("min_lat"), F.round("b.min_lng", 8).alias("min_lng")
    )


@query("SELECT n_nationkey AS k, substr(sha256(printf('%.4f,%.4f,%.4f,%.4f', n_nationkey * 1.5e0, n_regionkey * 2.25e0, n_nationkey * 1.5e0 + 1, n_regionkey * 2.25e0 + 1)), 1, 16) AS key FROM nation")
def src_28_network_key(spark, d):
    a, b = F.col("n_nationkey") * F.lit(1.5), F.col("n_regionkey") * F.lit(2.25)
    return D.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), tiles.box_key({"min_lat": a, "min_lng": b, "max_lat": a + 1, "max_lng": b + 1}).alias("key")
    )


@query(
    """WITH x AS (SELECT event_id AS id, least(1e0, greatest(0e0, value / 400)) AS s FROM events),
 y AS (SELECT id, CASE WHEN s < 0.5 THEN 204 ELSE floor(204 - (s - 0.5) / 0.5 * 170 + 0.5) END AS r, CASE WHEN s < 0.5 THEN floor(34 + s / 0.5 * 170 + 0.5) ELSE 204 END AS g FROM x)
 SELECT id, '#' || lpad(printf('%x', CAST(r AS BIGINT)), 2, '0') || lpad(printf('%x', CAST(g AS BIGINT)), 2, '0') || '22' AS colour FROM y"""
)
def snk_06_score_colour(spark, d):
    return D.table(spark, d, "events").select(F.col("event_id").alias("id"), export.score_colour(F.col("value") / 400).alias("colour"))


@query(
    f"""WITH {D.NODES_SQL}, x AS (SELECT id, CAST(floor(((degrees(atan2(sin(radians(lng + 85.66e0)) * cos(radians(lat)), cos(radians(42.95e0)) * sin(radians(lat)) -
 sin(radians(42.95e0)) * cos(radians(lat)) * cos(radians(lng + 85.66e0)))) + 360) % 360 + 22.5) % 360 / 45) AS BIGINT) AS sector FROM nodes0)
 SELECT sector, id, row_number() OVER (PARTITION BY sector ORDER BY (id * 7919) % 10007 DESC, id) AS rank FROM x QUALIFY rank <= 25"""
)
def ord_02_sector_topk(spark, d):
    b = geo.bearing(F.lit(42.95), F.lit(-85.66), F.col("lat"), F.col("lon"))
    x = D.osm_nodes(spark, d).select("id", F.floor((b + 22.5) % 360 / 45).cast("long").alias("sector"))
    order = Window.partitionBy("sector").orderBy(F.desc((F.col("id") * 7919) % 10007), "id")
    return x.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 25").select("sector", "id", "rank")


@query(
    """, st AS (SELECT s_suppkey AS start_id, 42.9e0 + s_suppkey % 40 * 0.0021e0 AS lat, -85.7e0 + s_suppkey % 50 * 0.0013e0 AS lng FROM supplier),
 deg AS (SELECT from_node AS node, count(*) AS ways FROM edges0 GROUP BY 1),
 nr AS (SELECT st.start_id, n.id AS node, ways, 2 * 6371000e0 * asin(sqrt(power(sin(radians(n.lat - st.lat) / 2), 2) + cos(radians(st.lat)) * cos(radians(n.lat)) * power(sin(radians(n.lng - st.lng) / 2), 2))) AS dist
  FROM st, nodes0 n JOIN deg ON deg.node = n.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY dist, CAST(node AS VARCHAR)) AS k FROM nr WHERE dist <= 5000),
 l AS (SELECT *, greatest(3 * min(dist) OVER (PARTITION BY start_id), 500) AS lim FROM r WHERE k <= 50),
 b AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY (ways >= 3 AND dist <= lim) DESC, CASE WHEN ways >= 3 AND dist <= lim THEN -ways ELSE 0 END, dist, CAST(node AS VARCHAR)) AS o FROM l)
 SELECT start_id, CAST(node AS VARCHAR) AS node, round(dist, 4) AS distance FROM b WHERE o = 1""",
    observed=True,
)
def join_17_snap(spark, d):
    g = _graph(spark, d)
    s = D.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("start_id"),
        (F.lit(42.9) + F.col("s_suppkey") % 40 * F.lit(0.0021)).alias("lat"),
        (F.lit(-85.7) + F.col("s_suppkey") % 50 * F.lit(0.0013)).alias("lng"),
    )
    return search.snap(s, g.nodes, g.edges).select("start_id", "node", F.round("distance", 4).alias("distance"))


@query(
    f"""WITH {D.NODES_SQL}, h AS (SELECT id, lat, lng, 180e0 + (id * 37) % 101 * 0.5e0 AS z, id // 64 AS line, id % 64 AS pos FROM nodes0),
 s AS (SELECT line, z - lag(z) OVER w AS dz, 2 * 6371000e0 * asin(sqrt(power(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) *
 power(sin(radians(lng - lag(lng) OVER w) / 2), 2))) AS d FROM h WINDOW w AS (PARTITION BY line ORDER BY pos))
 SELECT CAST(line AS VARCHAR) AS edge_id, round(sum(greatest(dz, 0)), 4) AS gain, round(sum(greatest(-dz, 0)), 4) AS loss, round(max(abs(dz) / d * 100), 4) AS max_grade FROM s GROUP BY 1 HAVING count(*) >= 2"""
)
def agg_05_edge_climbs(spark, d):
    k = F.col("id")
    p = D.osm_nodes(spark, d).select(
        F.floor(k / 64).cast("string").alias("edge_id"), (k % 64).alias("pos"), "lat", F.col("lon").alias("lng"), (F.lit(180.0) + (k * 37) % 101 * 0.5).alias("z")
    )
    c = elevation.edge_climbs(p).where("known >= 2")
    return c.select("edge_id", F.round("gain", 4).alias("gain"), F.round("loss", 4).alias("loss"), F.round("max_grade", 4).alias("max_grade"))


@query(f"WITH {D.NODES_SQL} SELECT id, floor(lat * 100 + 0.5) / 100 AS lat2, floor(-lng * 10 + 0.5) / 10 AS lng1 FROM nodes0")
def fmt_01_round(spark, d):
    return D.osm_nodes(spark, d).select("id", round_half_up(F.col("lat"), 2).alias("lat2"), round_half_up(-F.col("lon"), 1).alias("lng1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road classes and surfaces of the derived street graph."""
    return agg_21_distribution(spark, sf_dir)


